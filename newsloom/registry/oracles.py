"""The SQL each checked query must agree with, written for DuckDB on the given tables."""

from __future__ import annotations

from newsloom.registry.queries import (
    ANYWHERE,
    EXCLUDED,
    FIRST_YEAR,
    MARKET,
    NAMES,
    PATTERNS,
    PREFIX,
    TERMS,
)
from newsloom.registry.views import LEXICON_SQL

# Fixed value: the word form, in the dialect without possessive quantifiers.
WORDS = r"(?:\pL[\pL\pM]*(?:[.:·''’]\pL[\pL\pM]*)*|\pN+(?:[.,;''’]\pN+)*|_)+"

VIEWS = {
    "articles": r"""
        select doc_id as id, concat('/story/', cast(doc_id as varchar)) as url, source as kicker,
               split_part(text, chr(10), 1) as title, split_part(text, chr(10), 2) as subtitle,
               case when doc_id % 17 = 0 then '' else concat(lang, '-', cast(doc_id % 17 as varchar)) end as origins,
               cast(date '1995-01-02' + cast(doc_id * 7 % 400 as integer) as date) as pubdate,
               text as body
        from documents""",
    "scored": """
        select a.*, cast(l.quality as double) as sentiment
        from articles a left join labels l on l.doc_id = a.id""",
    "lex": LEXICON_SQL,
    "prices": """
        select cast(o_orderdate as date) as date, max(o_totalprice) as close
        from orders where isodow(o_orderdate) < 6 group by 1""",
    "words": f"select id, unnest(regexp_extract_all(lower(body), '{WORDS}')) as word from articles",
    "scores": """
        select a.id, round(coalesce(s.score, 0), 6) as score
        from articles a left join
             (select w.id, sum(l.value) as score from words w join lex l on l.word = w.word group by 1) s
             on s.id = a.id""",
    "page_links": r"""
        select url as page_url, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) as url from pages""",
    "frontier": """
        select url, date '2024-02-01' as datum, cast(0 as integer) as downloaded from pages
        union all
        select url, date '2024-02-02', cast(starts_with(page_url, 'http://') as integer) from page_links""",
    "collected": "select url from page_links where starts_with(page_url, 'http://')",
    "outcomes": """
        select distinct url, length(url) > 6 as failed from page_links
        where starts_with(page_url, 'https://')""",
    "updated": """
        select case when coalesce(o.failed, false) then null else f.url end as url, f.datum,
               case when f.downloaded = 0 and o.failed then 2
                    when f.downloaded = 0 and not o.failed then 1
                    else f.downloaded end as downloaded
        from frontier f left join outcomes o on o.url = f.url""",
    "markup": r"""
        select id, url, regexp_replace(kicker, '^\s+', '') as kicker,
               regexp_replace(title, '^\s+', '') as title,
               case when subtitle <> '' then regexp_replace(subtitle, '^\s+', '') end as subtitle,
               trim(origins) as origins,
               case when not starts_with(origins, 'es-')
                    then cast(pubdate as timestamp) + interval '8 hours 30 minutes' end as pubdate,
               regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', '') as body
        from articles""",
    "tagged": "select *, "
    + ", ".join(f"regexp_matches(body, '{p}') as {name}" for name, p in PATTERNS.items())
    + " from articles",
    "exclusive": "select *, case "
    + " ".join(f"when {flag} then '{label}'" for flag, label in NAMES.items())
    + " end as label from tagged where "
    + " + ".join(f"cast({flag} as integer)" for flag in NAMES)
    + " = 1",
    "top_origins": """
        select origins, count(*) as n from articles group by 1
        order by n desc, origins asc nulls last limit 10""",
}

# which view a view is built on
NEEDS = {
    "scored": ["articles"],
    "words": ["articles"],
    "scores": ["articles", "lex", "words"],
    "frontier": ["page_links"],
    "collected": ["page_links"],
    "outcomes": ["page_links"],
    "updated": ["frontier", "outcomes"],
    "markup": ["articles"],
    "tagged": ["articles"],
    "exclusive": ["tagged"],
    "top_origins": ["articles"],
}


def _with(views: list[str], sql: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        add(name)
    if not ordered:
        return sql
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in ordered) + "\n" + sql


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _labelled(groups: str, value: str, floor: float, weighted: str | None = None) -> str:
    """Quantile labels over a named result; ``weighted`` is the row-level result to take quantiles of."""
    return f"""
        , limits as (
            select least(round(quantile_cont({value}, 0.05), 9), {-floor}) as low,
                   greatest(round(quantile_cont({value}, 0.95), 9), {floor}) as high
            from {weighted or groups})
        select g.*, case when g.{value} > (select high from limits) then 'positiv'
                         when g.{value} < (select low from limits) then 'negativ'
                         else 'neutral' end as sentiment
        from {groups} g"""


def _tagged_sentiment(where: str, label: str, k: int, floor: float, blank: str = "") -> str:
    return (
        _with(["articles", "scores"], "")
        + f""", chosen as (select a.*, s.score from articles a join scores s on s.id = a.id where {where}),
        top as (select {label}, count(*) as n from chosen group by 1
                order by n desc, {label} asc nulls last limit {k}),
        groups as (
            select pubdate, {label} as new_kicker, count(*) as n, cast(1 as double) as percentage,
                   round(sum(score), 6) as sum_sentiment
            from chosen
            where {label} in (select {label} from top) and {label} <> 'sonstiges' {blank}
            group by 1, 2)"""
        + _labelled("groups", "sum_sentiment", floor)
    )


def _fields() -> str:
    raw = {
        "kicker": "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)",
        "title": "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)",
        "origins": """regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1)""",
        "body": "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)",
    }
    clean = {
        name: "regexp_replace(regexp_replace(regexp_replace("
        f"{e}, '<[^>]*>', '', 'g'), '&quot;', '\"', 'g'), '&amp;?', '&', 'g')"
        for name, e in raw.items()
    }
    return f"""
        select page_id, url, regexp_replace({clean['kicker']}, '^\\s+', '') as kicker,
               regexp_replace({clean['title']}, '^\\s+', '') as title,
               trim({clean['origins']}, chr(10) || chr(9) || ' ') as origins, '' as section,
               trim({clean['body']}, chr(10) || chr(9) || ' ') as body
        from pages"""


def oracle_sql() -> dict[str, str]:
    a = ["articles"]
    letters = "(length(body) - length(replace(body, '{0}', '')))"
    e, pos, neg = letters.format("e"), f"2 * {letters.format('a')}", f"2 * {letters.format('o')}"
    any_of_three = " or ".join(f"regexp_matches({c}, '{ANYWHERE}')" for c in ("body", "title", "subtitle"))
    prefix_of_three = " or ".join(f"regexp_matches({c}, '{PREFIX}')" for c in ("body", "title", "subtitle"))
    given = ("documents", "embeddings", "events", "orders", "pages")
    groups = """, groups as (select a.pubdate, a.kicker, count(*) as n, round(sum(s.score), 6) as sum_sentiment
                from articles a join scores s on s.id = a.id group by 1, 2)"""
    sql = {
        "scan_articles": _with(a, "select * from articles"),
        "project_urls": _with(a, "select url from articles"),
        "unscored_rows": _with(["scored"], "select id, body from scored where sentiment is null"),
        "csv_roundtrip": _with(["frontier"], "select url, downloaded, datum from frontier"),
        "feather_roundtrip": _with(["frontier"], "select * from frontier"),
        "lexicon_load": """
            select word, cast(count(*) * 0.25 as double) as value
            from (select unnest(regexp_extract_all(lower(text), '[\\pL\\pN]+')) as word from benchmark) group by 1""",
        "prices_since": _with(["prices"], "select * from prices where date >= date '1999-01-01'"),
        "catalog_tables": " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in given),
        "page_input": "select url, html from pages",
        "create_and_append": _with(
            a,
            """select row_number() over (order by pubdate >= date '1995-06-01', url) as id, url, pubdate
               from articles""",
        ),
        "add_missing_column": _with(a, "select id, url, cast(null as double) as sentiment from articles"),
        "update_by_key": _with(
            a,
            """select a.id, a.url, cast(l.toxic as double) as sentiment
               from articles a left join labels l on l.doc_id = a.id""",
        ),
        "delete_in_subquery": _with(
            a,
            """select id, url, title from articles where id not in
               (select min(id) from articles group by title, subtitle having count(*) > 1)""",
        ),
        "delete_not_in_subquery": _with(
            a,
            "select id, url, title from articles where id in (select min(id) from articles group by title, subtitle)",
        ),
        "frontier_links": _with(["page_links"], "select page_url, url from page_links"),
        "page_fields": _fields(),
        "article_extract": _with(
            ["markup"], "select * from markup where subtitle is not null and pubdate is not null"
        ),
        "article_rejects": _with(["markup"], "select url from markup where subtitle is null or pubdate is null"),
        "optional_origins": _with(["markup"], "select id, origins, origins = '' as absent from markup"),
        "pubdate_parse": _with(["markup"], "select id, pubdate from markup"),
        "constant_columns": _with(
            a, "select url, date '2024-02-03' as datum, cast(0 as integer) as downloaded from articles"
        ),
        "drop_columns": _with(a, "select id, kicker, title from articles"),
        "one_column_frame": _with(["frontier"], "select url from frontier"),
        "tag_names": _with(
            ["tagged"],
            "select id, case "
            + " ".join(f"when {flag} then '{label}'" for flag, label in NAMES.items())
            + " end as label from tagged",
        ),
        "sign_labels": _with(
            ["scored"],
            """select id, case when sentiment > 0 then 'positiv' when sentiment < 0 then 'negativ'
                               else 'neutral' end as sentiment from scored""",
        ),
        "type_changes": """
            select event_id, cast(ts as date) as day, cast(user_id as varchar) as user_text,
                   cast(user_id as double) as user_number from events""",
        "pending_only": _with(["frontier"], "select * from frontier where downloaded = 0"),
        "skip_absolute_urls": _with(["frontier"], "select * from frontier where not contains(url, '://')"),
        "drop_null_urls": _with(["updated"], "select * from updated where url is not null"),
        "body_regex": _with(["tagged"], "select id from tagged where german"),
        "any_column_regex": _with(a, f"select id from articles where {any_of_three}"),
        "term_list_regex": _with(a, f"select id from articles where regexp_matches(body, '{'|'.join(TERMS)}')"),
        "tagged_rows": _with(a, f"select id, kicker from articles where regexp_matches(body, '{MARKET}')"),
        "drop_catch_all": _with(
            ["articles", "top_origins"],
            """select id, origins as new_origins from articles
               where origins in (select origins from top_origins) and origins not in ('sonstiges', '')""",
        ),
        "exclude_values": _with(a, f"select id, origins from articles where origins not in {_list(EXCLUDED)}"),
        "year_floor": _with(
            a,
            f"""select id, pubdate, cast(year(pubdate) as integer) as year
                from articles where year(pubdate) >= {FIRST_YEAR}""",
        ),
        "drop_any_null": _with(["scored"], "select id, kicker, sentiment from scored where sentiment is not null"),
        "forget_one_url": _with(["frontier"], "select * from frontier where url is distinct from '/the'"),
        "collected_removed": _with(
            ["frontier", "collected"], "select * from frontier where url not in (select url from collected)"
        ),
        "collected_removed_large": _with(
            ["frontier", "collected"], "select * from frontier where url not in (select url from collected)"
        ),
        "lexicon_hits": _with(
            ["words", "lex"],
            """select w.id, w.word, l.value, count(*) as n from words w join lex l on l.word = w.word
               group by 1, 2, 3""",
        ),
        "articles_with_prices": _with(
            ["articles", "prices"],
            "select a.id, a.pubdate, a.kicker, p.close from articles a join prices p on p.date = a.pubdate",
        ),
        "top_k_membership": _with(
            a,
            """select id, origins from articles where origins in
               (select origins from (select origins, count(*) as n from articles group by 1
                                     order by n desc, origins limit 5))""",
        ),
        "label_counts": _with(a, "select kicker, count(*) as n from articles group by 1"),
        "day_author_counts": _with(a, "select pubdate, origins, count(*) as n from articles group by 1, 2"),
        "sum_by_two_keys": _with(
            ["scored"],
            "select pubdate, kicker, round(sum(sentiment), 6) as sum_sentiment from scored group by 1, 2",
        ),
        "high_water_mark": "select max(ts) as newest from events",
        "group_quantiles": _with(["articles", "scores"], "")
        + groups
        + """ select round(quantile_cont(sum_sentiment, 0.05), 9) as low,
                     round(quantile_cont(sum_sentiment, 0.95), 9) as high from groups""",
        "bounded_thresholds": _with(["articles", "scores"], "")
        + groups
        + """ , rows_ as (select g.sum_sentiment from groups g
                          join articles a on a.pubdate = g.pubdate and a.kicker = g.kicker)
              select least(round(quantile_cont(sum_sentiment, 0.05), 9), -1.0::double) as low,
                     greatest(round(quantile_cont(sum_sentiment, 0.95), 9), 1.0::double) as high from rows_""",
        "duplicate_groups": _with(
            a,
            """select title, subtitle, min(id) as oldest, count(*) as copies from articles
               group by 1, 2 having count(*) > 1""",
        ),
        "constant_share": _with(
            a, "select pubdate, kicker, count(*) as n, cast(1 as double) as percentage from articles group by 1, 2"
        ),
        "share_of_day": _with(
            a,
            """select pubdate, kicker, n, cast(n as double) / sum(n) over (partition by pubdate) as share_of_day
               from (select pubdate, kicker, count(*) as n from articles group by 1, 2)""",
        ),
        "repeated_group_values": _with(
            a, "select pubdate, kicker, count(*) over (partition by pubdate, kicker) as n from articles"
        ),
        "week_share": _with(
            a,
            """select week, origins, n, cast(n as double) / sum(n) over (partition by week) as percentage
               from (select cast(date_trunc('week', pubdate) as date) as week, origins, count(*) as n
                     from articles group by 1, 2)""",
        ),
        "append_keys": _with(
            a,
            """select id as old_id, url, kicker,
                      (select max(id) from articles) + row_number() over (order by kicker, url) as id
               from articles""",
        ),
        "top_k_labels": _with(["top_origins"], "select * from top_origins"),
        "lump_labels": _with(
            ["articles", "top_origins"],
            """select id, origins, case when origins in (select origins from top_origins) then origins
                                        else 'sonstiges' end as new_origins from articles""",
        ),
        "top_k_then_exclude": _with(
            a,
            f"""select * from (select origins, count(*) as n from articles group by 1
                               order by n desc, origins limit 50)
                where origins not in {_list(EXCLUDED)}""",
        ),
        "frontier_append": _with(
            ["frontier"],
            """select * from frontier
               union all select url, date '2024-02-03', cast(0 as integer) from page_links""",
        ),
        "csv_mixed_layouts": _with(["frontier"], "select * from frontier union all select url, null, null from frontier"),
        "feather_mixed_columns": _with(["frontier"], "select * from frontier union all select url, null, null from frontier"),
        "versioned_add_column": _with(
            a, "select id, title, cast(toxic as double) as sentiment from articles left join labels on doc_id = id"
        ),
        "version_without_rows": _with(a, "select id, title from articles where false"),
        "update_one_month": _with(
            a,
            """select id, case when month = '1995-03' then cast(id % 7 as double) end as sentiment, month
               from (select id, strftime(pubdate, '%Y-%m') as month from articles) where month <> '1995-03' or id % 7 <> 0""",
        ),
        "delete_whole_month": _with(
            a,
            """select id, cast(null as double) as sentiment, month from (select id, strftime(pubdate, '%Y-%m') as month from articles)
               where month <> '1995-03' and (month <> '1995-04' or id % 3 <> 0)""",
        ),
        "move_between_months": _with(
            a,
            """select id, cast(null as double) as sentiment,
                      case when month = '1995-03' or month = '1995-05' and id % 2 = 0
                           then case when id % 5 = 0 then '2001-01' else '1995-06' end else month end as month
               from (select id, strftime(pubdate, '%Y-%m') as month from articles)""",
        ),
        "stored_time_parse": """
            select event_id, case when event_id % 5 <> 0 then date_trunc('second', ts) end as pubdate from events""",
        "frontier_dates_fixed": """
            select cast(d as date) as date, concat('https://news.example/frontpage/', strftime(d, '%Y/%m/%d')) as url
            from generate_series(timestamp '2023-12-21', timestamp '2024-03-16', interval 1 day) as t(d)
            where cast(d as date) not in (select cast(ts as date) from events)""",
        "older_frontier_append": _with(
            ["frontier", "collected"],
            "select * from frontier union all select url, cast(null as date), 0 from collected",
        ),
        "front_page_urls": _with(
            a,
            """select id, concat('https://news.example/frontpage/', strftime(pubdate, '%Y/%m/%d')) as front_page,
                      concat('https://news.example', url) as article_page from articles""",
        ),
        "date_labels": """
            select event_id, cast(ts as date) as day, cast(date_trunc('week', ts) as date) as week,
                   cast(year(ts) as integer) as year, cast(cast(ts as date) + 1 as date) as next_day from events""",
        "trimmed_text": _with(
            a,
            r"""select id,
                       regexp_replace(body, '^\s+', '') || ' ' || chr(9) || chr(10) || chr(10) as left_trimmed,
                       regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', '') as both_trimmed
                from articles""",
        ),
        "word_tokens": _with(["words"], "select word, count(*) as n from words group by 1"),
        "word_runs": _with(
            a,
            r"""select word, count(*) as n
                from (select unnest(regexp_extract_all(lower(body), '[\pL\pN]+')) as word from articles) group by 1""",
        ),
        "rounded_values": "select event_id, round(value / 7, 6) as rounded from events",
        "softmax_probabilities": """
            select vec_id, round(exp(a - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) as p0,
                   round(exp(b - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) as p1,
                   round(exp(c - m) / (exp(a - m) + exp(b - m) + exp(c - m)), 6) as p2
            from (select *, greatest(a, b, c) as m from
                  (select vec_id, round(list_sum([cast(x as double) for x, i in embedding if (i - 1) % 3 = 0]), 9) as a, round(list_sum([cast(x as double) for x, i in embedding if (i - 1) % 3 = 1]), 9) as b, round(list_sum([cast(x as double) for x, i in embedding if (i - 1) % 3 = 2]), 9) as c from embeddings))""",
        "softmax_label": """
            select vec_id, cast(case when b >= greatest(a, c) then 1 when c >= greatest(a, b) then -1 else 0 end as double) as sentiment
            from (select vec_id, round(list_sum([cast(x as double) for x, i in embedding if (i - 1) % 3 = 0]), 9) as a, round(list_sum([cast(x as double) for x, i in embedding if (i - 1) % 3 = 1]), 9) as b, round(list_sum([cast(x as double) for x, i in embedding if (i - 1) % 3 = 2]), 9) as c from embeddings)""",
        "model_input_words": _with(
            a,
            f"""select id, cast(len(tokens) as integer) as n_tokens,
                       array_to_string(tokens[1:128], ' ') as model_input
                from (select id, regexp_extract_all(lower(body), '{WORDS}') as tokens from articles)""",
        ),
        "tag_columns": _with(["tagged"], f"select id, {', '.join(PATTERNS)} from tagged"),
        "exclusive_tags": _with(["exclusive"], "select id, label from exclusive"),
        "lexicon_score": _with(["scores"], "select * from scores"),
        "lexicon_score_large": _with(
            ["words"],
            r""", large as (select word, cast(count(*) * 0.25 as double) as value
                          from (select unnest(regexp_extract_all(lower(text), '[\pL\pN]+')) as word from benchmark)
                          group by 1)
               select a.id, round(coalesce(s.score, 0), 6) as score from articles a left join
                 (select w.id, sum(l.value) as score from words w join large l on l.word = w.word group by 1) s
               on s.id = a.id""",
        ),
        "classify_extremes": _with(["scores"], "") + _labelled("scores", "score", 0.05),
        "article_quantiles": """
            select round(quantile_cont(value, 0.05), 9) as low, round(quantile_cont(value, 0.95), 9) as high
            from events""",
        "dedup_second_oldest": _with(
            a,
            """select * exclude (copies, place) from
               (select *, count(*) over (partition by title, subtitle) as copies,
                       row_number() over (partition by title, subtitle order by id) as place from articles)
               where copies = 1 or place = 2""",
        ),
        "dedup_incremental": _with(
            a,
            """select id, title, subtitle from
               (select *, count(*) over (partition by title, subtitle) as copies,
                       row_number() over (partition by title, subtitle order by id) as place from articles)
               where copies = 1 or place = 2""",
        ),
        "write_new_version": _with(
            a,
            """select id, title, subtitle from
               (select *, count(*) over (partition by title, subtitle) as copies,
                       row_number() over (partition by title, subtitle order by id) as place from articles)
               where copies = 1 or place = 2""",
        ),
        "frontier_dates": """
            select d as date, concat('https://news.example/frontpage/', strftime(d, '%Y/%m/%d')) as url
            from (select cast(unnest(generate_series(cast(max(ts) as date) + 1, date '2024-03-16',
                                                     interval 1 day)) as date) as d from events)""",
        "frontier_dates_none": """
            select cast(max(ts) as date) as date, '' as url from events having max(ts) < timestamp '2023-12-02'""",
        "frontier_pending": _with(
            ["frontier", "collected"],
            """select * from frontier where url is not null and not contains(url, '://')
               and url not in (select url from collected)""",
        ),
        "grown_frontier": _with(
            ["frontier"],
            r"""select * from frontier union all
               select unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)), date '2024-03-15', cast(0 as integer)
               from pages, (select cast(max(ts) as date) as newest from events)
               where date '2024-01-01' + cast(page_id as integer) between newest + 1 and date '2024-03-16'""",
        ),
        "collected_articles": _with(
            ["markup"],
            """select * exclude (id) from markup where subtitle is not null and pubdate is not null
               and id not in (select doc_id from labels)""",
        ),
        "frontier_after_collection": _with(
            ["markup", "frontier"],
            """select case when waiting and not ok then null else url end as url, date '2024-02-03' as datum,
                      cast(case when not waiting then 0 when ok then 1 else 2 end as integer) as downloaded
               from (select url, id not in (select doc_id from labels) as waiting,
                            subtitle is not null and pubdate is not null as ok from markup)
               union all select * from frontier""",
        ),
        "frontier_outcome": _with(["updated"], "select * from updated"),
        "frontier_outcome_log": _with(["updated"], "select * from updated"),
        "score_missing_merge": _with(
            ["scored"],
            f"""select id, url, coalesce(sentiment, case when {pos} >= greatest({e}, {neg}) then 1.0
                                                         when {neg} >= greatest({e}, {pos}) then -1.0
                                                         else 0.0 end)::double as sentiment from scored""",
        ),
        "model_logits": _with(
            ["scored"],
            f"""select id, cast({e} as double) as class0, cast({pos} as double) as class1,
                       cast({neg} as double) as class2 from scored where sentiment is null""",
        ),
        "weekly_label_share": _with(
            a,
            """, top as (select kicker, count(*) as n from articles group by 1 order by n desc, kicker limit 10),
               counts as (select cast(date_trunc('week', pubdate) as date) as week, kicker as new_kicker,
                                 count(*) as n
                          from articles where kicker in (select kicker from top) and kicker <> 'sonstiges'
                          group by 1, 2)
               select *, cast(n as double) / sum(n) over (partition by week) as percentage from counts""",
        ),
        "author_daily_activity": _with(
            a,
            f""", top as (select origins, count(*) as n from articles group by 1 order by n desc, origins limit 50)
               select pubdate as day, origins, count(*) as n from articles
               where origins in (select origins from top where origins not in {_list(EXCLUDED)})
                 and year(pubdate) >= {FIRST_YEAR} group by 1, 2""",
        ),
        "exclusive_tag_sentiment": _with(["exclusive", "scores"], "")
        + """, groups as (
                select e.pubdate, e.label as party, count(*) as n, cast(1 as double) as percentage,
                       round(sum(s.score), 6) as sum_sentiment
                from exclusive e join scores s on s.id = e.id group by 1, 2)"""
        + _labelled("groups", "sum_sentiment", 1),
        "term_sentiment_by_kicker": _tagged_sentiment(
            f"regexp_matches(body, '{'|'.join(TERMS)}')", "kicker", 10, 1
        ),
        "multi_column_tag_by_origin": _tagged_sentiment(f"({any_of_three})", "origins", 5, 0),
        "prefix_tag_by_kicker": _tagged_sentiment(f"({prefix_of_three})", "kicker", 5, 0, "and kicker <> ''"),
        "market_articles_with_index": _with(["articles", "scores", "prices"], "")
        + f""", chosen as (select a.*, s.score, p.close from articles a join scores s on s.id = a.id
                           join prices p on p.date = a.pubdate where regexp_matches(body, '{MARKET}')),
               top as (select kicker, count(*) as n from chosen group by 1 order by n desc, kicker limit 5),
               lumped as (select *, case when kicker in (select kicker from top) then kicker
                                         else 'sonstiges' end as new_kicker from chosen),
               rows_ as (select pubdate, new_kicker, count(*) over g as n, cast(1 as double) as percentage,
                                round(sum(score) over g, 6) as sum_sentiment, close as atx
                         from lumped window g as (partition by pubdate, new_kicker))"""
        + _labelled("rows_", "sum_sentiment", 0),
    }
    return {name: text.replace("\n\n", "\n") for name, text in sql.items()}
