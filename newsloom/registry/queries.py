"""Every checked query as a function of (session, folder of the given tables)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.functions import dates, scores, text
from newsloom.operators import bloom, counts, dedup, extract, extremes, frontier, scoring, sentiment, tags
from newsloom.operators.joins import repeat_rows, with_prices
from newsloom.plans import sentiment as sentiment_plans
from newsloom.plans import collection, trends
from newsloom.registry import scorer, views
from newsloom.session import shared_path, written_table
from newsloom.sources import feather, frontier_log, increments, sinks, tables

cloudpickle.register_pickle_by_value(scorer)

# Fixed values of the checks.  A word stands between non-word characters; both engines read this alike.
BASE = "://"
RUN_DATE = dt.date(2024, 2, 3)
TODAY = dt.date(2024, 3, 15)
PRICES_FROM = dt.date(1999, 1, 1)
EXCLUDED = ("", "en-1", "en-2")
FIRST_YEAR = 1996


def word(term: str) -> str:
    return rf"(^|[^\pL\pN_]){term}($|[^\pL\pN_])"


PATTERNS = {
    "german": word("für"),
    "french": word("les"),
    "english": word("with"),
    "other": f"{word('été')}|{word('para')}",
}
NAMES = {"german": "DE", "french": "FR", "english": "EN", "other": "XX"}
TERMS = ("für", "les plus", "les")
THREE_COLUMNS = ("body", "title", "subtitle")
ANYWHERE = f"{word('para')}|les"
PREFIX = r"(^|[^\pL\pN_])[Tt]h"
MARKET = rf"{word('und')}|tion($|[^\pL\pN_])|onte"

PAGE_FIELDS = (
    extract.Field("kicker", "title"),
    extract.Field("title", "h1"),
    extract.Field("origins", ".ad", trim="both", required=False),
    extract.Field("section", ".article-section", trim="both", required=False),
    extract.Field("body", "article", trim="both"),
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


# ---- sources and sinks


@query
def scan_articles(spark, sf):
    views.articles(spark, sf).createOrReplaceTempView("newsloom_articles")
    return tables.read_table(spark, "newsloom_articles")


@query
def project_urls(spark, sf):
    views.articles(spark, sf).createOrReplaceTempView("newsloom_articles")
    return tables.read_table(spark, "newsloom_articles", ["url"])


@query
def unscored_rows(spark, sf):
    return scoring.unscored(views.scored_articles(spark, sf)).select("id", "body")


@query
def csv_roundtrip(spark, sf):
    path = shared_path(spark, "frontier-csv")
    sinks.write_csv(views.frontier(spark, sf), path)
    return tables.read_csv(spark, path, schemas.FRONTIER, ["url", "downloaded", "datum"])


@query
def feather_roundtrip(spark, sf):
    path = shared_path(spark, "frontier-feather")
    feather.write_feather(views.frontier(spark, sf), path)
    return feather.read_feather(spark, path)


@query
def csv_mixed_layouts(spark, sf):
    """Files with an index column and files with the full header in one folder."""
    path, table = shared_path(spark, "mixed-csv"), views.frontier(spark, sf)
    sinks.write_csv(table.select("url", "datum", "downloaded"), path)
    older = table.select(F.xxhash64("url").alias("index"), "url")
    older.write.mode("append").option("header", True).option("escape", '"').csv(path)
    return tables.read_csv(spark, path, schemas.FRONTIER)


@query
def feather_mixed_columns(spark, sf):
    """Files of different columns, some in a subfolder."""
    path, table = shared_path(spark, "mixed-feather"), views.frontier(spark, sf)
    feather.write_feather(table.select("url"), path)
    feather.write_feather(table, f"{path}/older")
    return feather.read_feather(spark, path).select("url", "datum", "downloaded")


@query
def versioned_add_column(spark, sf):
    """A version with a column that the one before lacks."""
    root = shared_path(spark, "wider")
    sinks.write_version(views.articles(spark, sf).select("id", "title"), root, 1)
    wider = scoring.add_column_if_absent(sinks.read_latest(spark, root), "sentiment")
    labels = views.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("sentiment"))
    sinks.write_version(scoring.update_by_key(wider, labels), root, 2)
    return sinks.read_latest(spark, root)


@query
def version_without_rows(spark, sf):
    """After all rows are deleted the newest version is empty; older rows do not come back."""
    root = shared_path(spark, "emptied")
    sinks.write_version(views.articles(spark, sf).select("id", "title"), root, 1)
    stored = sinks.read_latest(spark, root)
    sinks.write_version(dedup.delete_ids(stored, stored.select("id")), root, 2)
    return sinks.read_latest(spark, root)


def _months(spark, sf):
    """A table partitioned by month, and where it lies."""
    name = "newsloom_" + shared_path(spark, "t").rsplit("-", 1)[1]
    base = views.articles(spark, sf).select("id", F.lit(None).cast("double").alias("sentiment"), F.date_format("pubdate", "yyyy-MM").alias("month"))
    sinks.create_if_absent(spark, name, where := shared_path(spark, "months"), base.schema, ["month"])
    base.write.insertInto(name)
    return base, name, where


def _stored_months(spark, name, where):
    """What the files hold, after the catalog's entry is dropped (the table is external: the files stay)."""
    spark.sql(f"DROP TABLE {name}")
    return tables.read_parquet(spark, where).select("id", "sentiment", F.col("month").cast("string").alias("month"))


@query
def update_one_month(spark, sf):
    """Update and delete by key in a table partitioned by month; the other months' files stay as they are."""
    base, name, where = _months(spark, sf)
    changes = base.filter(F.col("month") == "1995-03").select("id", "month", (F.col("id") % 7).cast("double").alias("sentiment"))

    def change(rows, new):
        kept = dedup.delete_ids(rows, new.filter(F.col("sentiment") == 0).select("id"))
        return scoring.update_by_key(kept, new.select("id", "sentiment"))

    sinks.rewrite_partitions(spark, name, changes, "month", change)
    return _stored_months(spark, name, where)


@query
def delete_whole_month(spark, sf):
    """Deleting all ids of a month leaves no partition behind; of the month after it every third row goes."""
    base, name, where = _months(spark, sf)
    doomed = base.filter("month = '1995-03' or month = '1995-04' and id % 3 = 0").select("id", "month")
    sinks.rewrite_partitions(spark, name, doomed, "month", lambda rows, gone: dedup.delete_ids(rows, gone.select("id")))
    return _stored_months(spark, name, where)


@query
def move_between_months(spark, sf):
    """Rows that change their month: one month loses some, one all, an existing and a new one gain."""
    base, name, where = _months(spark, sf)
    moves = base.filter("month = '1995-03' or month = '1995-05' and id % 2 = 0").select(
        "id", "month", F.when(F.col("id") % 5 == 0, "2001-01").otherwise("1995-06").alias("to")
    )

    def change(rows, new):
        moved = rows.join(new.select("id", "to"), "id", "left")
        return moved.withColumn("month", F.coalesce("to", "month")).drop("to")

    sinks.rewrite_partitions(spark, name, moves, "month", change)
    return _stored_months(spark, name, where)


@query
def lexicon_load(spark, sf):
    path = shared_path(spark, "lexicon-csv")
    sinks.write_csv(views.derived_lexicon(spark, sf), path)
    return tables.read_lexicon(spark, path)


@query
def prices_since(spark, sf):
    return tables.prices_since(views.prices(spark, sf), PRICES_FROM)


@query
def catalog_tables(spark, sf):
    """List the catalog without bookkeeping tables and scan what is listed."""
    prefix = "newsloom_given_"
    for name in ("documents", "embeddings", "events", "orders", "pages", "labels"):
        views.table(spark, sf, name).createOrReplaceTempView(prefix + name)
    system = (prefix + "labels",)
    listed = [name for name in tables.user_tables(spark, system) if name.startswith(prefix)]
    found = [
        tables.read_table(spark, name).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name.removeprefix(prefix)).alias("table_name"), "n"
        )
        for name in listed
    ]
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    return every


@query
def page_input(spark, sf):
    return tables.read_parquet(spark, f"{sf}/pages.parquet", ["url", "html"])


@query
def create_and_append(spark, sf):
    """Create the table twice, append two batches, read them back."""
    name = "newsloom_" + shared_path(spark, "t").rsplit("-", 1)[1]
    where = shared_path(spark, "articles")
    stored = views.articles(spark, sf).withColumn("pubdate", F.col("pubdate").cast("timestamp_ntz"))
    new = stored.drop("id")
    old = new.filter(F.col("pubdate") < F.lit(dt.date(1995, 6, 1)))
    rest = new.filter(F.col("pubdate") >= F.lit(dt.date(1995, 6, 1)))
    for batch in (old, rest):
        sinks.create_if_absent(spark, name, where)
        sinks.append_articles(spark, name, batch, order_by=["url"])
    whole = tables.read_parquet(spark, where)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    return whole.select("id", "url", F.to_date("pubdate").alias("pubdate"))


@query
def add_missing_column(spark, sf):
    plain = scoring.add_column_if_absent(views.articles(spark, sf), "sentiment")
    return scoring.add_column_if_absent(plain, "sentiment").select("id", "url", "sentiment")


@query
def update_by_key(spark, sf):
    base = scoring.add_column_if_absent(views.articles(spark, sf), "sentiment").select("id", "url", "sentiment")
    new = views.table(spark, sf, "labels").select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("sentiment")
    )
    return scoring.update_by_key(base, new)


@query
def delete_in_subquery(spark, sf):
    return dedup.delete_oldest_duplicate(views.articles(spark, sf)).select("id", "url", "title")


@query
def delete_not_in_subquery(spark, sf):
    return dedup.keep_oldest(views.articles(spark, sf)).select("id", "url", "title")


@query
def write_new_version(spark, sf):
    """Store the articles, store the cleaned ones as the next version, read the newest."""
    root = shared_path(spark, "versions")
    sinks.write_version(views.articles(spark, sf).select("id", "title", "subtitle"), root, 1)
    sinks.write_version(dedup.dedup_second_oldest(sinks.read_latest(spark, root)), root, 2)
    return sinks.read_latest(spark, root)


# ---- pages


@query
def frontier_links(spark, sf):
    return views.page_links(spark, sf)


@query
def page_fields(spark, sf):
    pages = views.dealt(views.pages(spark, sf), "page_id")
    return extract.accepted(extract.read_articles(pages, PAGE_FIELDS))


def _read_markup(spark, sf):
    return extract.read_articles(views.dealt(views.article_markup(spark, sf), "id"))


@query
def article_extract(spark, sf):
    return extract.accepted(_read_markup(spark, sf))


@query
def article_rejects(spark, sf):
    return extract.rejected(_read_markup(spark, sf))


@query
def optional_origins(spark, sf):
    return _read_markup(spark, sf).select("id", "origins", (F.col("origins") == "").alias("absent"))


@query
def pubdate_parse(spark, sf):
    return _read_markup(spark, sf).select("id", "pubdate")


@query
def stored_time_parse(spark, sf):
    """Times kept as text, read back; those of the page format are not of this form."""
    kept = F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return views.table(spark, sf, "events").select("event_id", dates.stored_time(kept).alias("pubdate"))


# ---- projections


@query
def constant_columns(spark, sf):
    return frontier.new_entries(views.articles(spark, sf), RUN_DATE)


@query
def drop_columns(spark, sf):
    flagged = tags.tag(views.articles(spark, sf).select("id", "kicker", "title"), PATTERNS, ["title"])
    return flagged.drop(*PATTERNS)


@query
def one_column_frame(spark, sf):
    return views.frontier(spark, sf).select("url")


@query
def tag_names(spark, sf):
    flagged = tags.tag(views.wide_articles(spark, sf), PATTERNS)
    return flagged.select("id", tags.first_label(NAMES).alias("label"))


@query
def sign_labels(spark, sf):
    """Nested conditional on a stored value."""
    value = F.col("sentiment")
    return views.scored_articles(spark, sf).select(
        "id",
        F.when(value > 0, extremes.POSITIVE).when(value < 0, extremes.NEGATIVE).otherwise(extremes.NEUTRAL).alias("sentiment"),
    )


@query
def type_changes(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id",
        F.to_date("ts").alias("day"),
        F.col("user_id").cast("string").alias("user_text"),
        F.col("user_id").cast("string").cast("double").alias("user_number"),
    )


# ---- filters


@query
def pending_only(spark, sf):
    return frontier.todo(views.frontier(spark, sf))


@query
def skip_absolute_urls(spark, sf):
    return frontier.without_absolute(views.frontier(spark, sf), BASE)


def _failed_nulled(spark, sf):
    links = views.stored_links(spark, sf)
    return frontier.apply_outcomes(views.frontier(spark, sf, links), views.link_outcomes(links))


@query
def drop_null_urls(spark, sf):
    return _failed_nulled(spark, sf).dropna(subset=["url"])


@query
def body_regex(spark, sf):
    return views.wide_articles(spark, sf).filter(text.matches(F.col("body"), PATTERNS["german"])).select("id")


@query
def any_column_regex(spark, sf):
    return views.wide_articles(spark, sf).filter(text.matches_any(THREE_COLUMNS, ANYWHERE)).select("id")


@query
def term_list_regex(spark, sf):
    return views.wide_articles(spark, sf).filter(text.matches_any(["body"], text.any_of(TERMS))).select("id")


@query
def tagged_rows(spark, sf):
    flagged = tags.tag(views.wide_articles(spark, sf), {"market": MARKET})
    return flagged.filter("market").select("id", "kicker")


@query
def drop_catch_all(spark, sf):
    base = views.articles(spark, sf)
    lumped = counts.lump(base, counts.top_k(base, "origins", 10), "origins", "new_origins")
    return lumped.filter((F.col("new_origins") != counts.OTHER) & (F.col("new_origins") != "")).select(
        "id", "new_origins"
    )


@query
def exclude_values(spark, sf):
    return counts.exclude(views.articles(spark, sf), "origins", EXCLUDED).select("id", "origins")


@query
def year_floor(spark, sf):
    return views.articles(spark, sf).filter(F.col("pubdate") >= F.lit(dt.date(FIRST_YEAR, 1, 1))).select(
        "id", "pubdate", F.year("pubdate").alias("year")
    )


@query
def drop_any_null(spark, sf):
    return views.scored_articles(spark, sf).select("id", "kicker", "sentiment").dropna("any")


@query
def forget_one_url(spark, sf):
    return frontier.forget_url(views.frontier(spark, sf), "/the")


# ---- joins


@query
def collected_removed(spark, sf):
    links = views.stored_links(spark, sf)
    return frontier.not_collected(views.frontier(spark, sf, links), views.collected(links))


@query
def collected_removed_large(spark, sf):
    """The same where stored addresses are too many to broadcast: a Bloom filter tells which rows need the exact join."""
    links = views.stored_links(spark, sf)
    return bloom.without_keys(views.frontier(spark, sf, links), views.collected(links), "url")


@query
def lexicon_hits(spark, sf):
    words = sentiment.article_words(views.wide_articles(spark, sf), "id")
    hits = sentiment.lexicon_hits(words, views.lexicon(spark))
    return hits.groupBy("id", "word", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def articles_with_prices(spark, sf):
    base = views.articles(spark, sf).select("id", "pubdate", "kicker")
    return with_prices(base, views.prices(spark, sf))


@query
def top_k_membership(spark, sf):
    base = views.articles(spark, sf)
    return counts.keep_top(base, counts.top_k(base, "origins", 5), "origins").select("id", "origins")


# ---- aggregates


@query
def label_counts(spark, sf):
    return counts.count_by(views.articles(spark, sf), "kicker")


@query
def day_author_counts(spark, sf):
    return counts.count_by(views.articles(spark, sf), "pubdate", "origins")


@query
def sum_by_two_keys(spark, sf):
    return counts.sum_by(views.scored_articles(spark, sf), "sentiment", "pubdate", "kicker", out="sum_sentiment")


@query
def high_water_mark(spark, sf):
    return frontier.high_water_mark(views.table(spark, sf, "events"), "ts")


def _label_scores(spark, sf, label="kicker"):
    return sentiment_plans.daily_scores(views.wide_articles(spark, sf), views.lexicon(spark), label)


@query
def group_quantiles(spark, sf):
    return extremes.exact_quantiles(_label_scores(spark, sf), "sum_sentiment").drop("q")


@query
def bounded_thresholds(spark, sf):
    """Thresholds over all days and topics, each weighing as many times as it has articles."""
    return extremes.bounded_thresholds(extremes.exact_quantiles(_label_scores(spark, sf), "sum_sentiment", weight="n"), 1)


@query
def duplicate_groups(spark, sf):
    return dedup.duplicate_groups(views.articles(spark, sf))


@query
def constant_share(spark, sf):
    return sentiment_plans.with_constant_share(
        counts.count_by(views.articles(spark, sf), "pubdate", "kicker")
    )


@query
def share_of_day(spark, sf):
    return sentiment_plans.with_share_of_day(counts.count_by(views.articles(spark, sf), "pubdate", "kicker"))


@query
def repeated_group_values(spark, sf):
    """Day and topic counts repeated for each of their articles."""
    groups = counts.count_by(views.articles(spark, sf), "pubdate", "kicker")
    return repeat_rows(groups.withColumn("copies", F.col("n")), "copies")


# ---- windows, top-k, sets


@query
def week_share(spark, sf):
    weekly = counts.count_by(views.articles(spark, sf), dates.week(F.col("pubdate")).alias("week"), "origins")
    return counts.share_within(weekly, "n", "week")


@query
def append_keys(spark, sf):
    base = views.articles(spark, sf).select("id", "url", "kicker")
    start = sinks.next_key(base)
    return sinks.number_rows(base.withColumnRenamed("id", "old_id"), start, ["kicker", "url"])


@query
def top_k_labels(spark, sf):
    return counts.top_k(views.articles(spark, sf), "origins", 10)


@query
def lump_labels(spark, sf):
    base = views.articles(spark, sf)
    return counts.lump(base, counts.top_k(base, "origins", 10), "origins", "new_origins").select(
        "id", "origins", "new_origins"
    )


@query
def top_k_then_exclude(spark, sf):
    return counts.exclude(counts.top_k(views.articles(spark, sf), "origins", 50), "origins", EXCLUDED)


@query
def frontier_append(spark, sf):
    links = views.stored_links(spark, sf)
    known = views.frontier(spark, sf, links)
    fresh = frontier.new_entries(links, RUN_DATE)
    return frontier.append_frontier(known, fresh)


@query
def older_frontier_append(spark, sf):
    """A frontier of addresses only next to the full form: no day, nothing downloaded yet."""
    links = views.stored_links(spark, sf)
    return frontier.append_frontier(views.frontier(spark, sf, links), views.collected(links))


# ---- scalar functions


@query
def front_page_urls(spark, sf):
    return views.articles(spark, sf).select(
        "id",
        text.absolute_url("https://news.example/frontpage/", dates.day_path(F.col("pubdate"))).alias("front_page"),
        text.absolute_url("https://news.example", F.col("url")).alias("article_page"),
    )


@query
def date_labels(spark, sf):
    ts = F.col("ts")
    return views.table(spark, sf, "events").select(
        "event_id",
        dates.day(ts).alias("day"),
        dates.week(ts).alias("week"),
        F.year(ts).alias("year"),
        F.date_add(dates.day(ts), 1).alias("next_day"),
    )


@query
def trimmed_text(spark, sf):
    """Both trims on text padded with blanks, tabs and line breaks."""
    padded = F.concat(F.lit("\n\t "), F.col("body"), F.lit(" \t\n\n"))
    return views.articles(spark, sf).select(
        "id", text.trim_left(padded).alias("left_trimmed"), text.trim_both(padded).alias("both_trimmed")
    )


@query
def word_tokens(spark, sf):
    """How often each word occurs in all articles."""
    words = sentiment.article_words(views.wide_articles(spark, sf), "id").filter(F.col("word").isNotNull())
    return counts.count_by(words, "word")


@query
def word_runs(spark, sf):
    """The plain token form: runs of letters and digits."""
    words = sentiment.article_words(views.wide_articles(spark, sf), "id", pattern=text.WORD_RUNS)
    return counts.count_by(words.filter(F.col("word").isNotNull()), "word")


@query
def rounded_values(spark, sf):
    return views.table(spark, sf, "events").select(
        "event_id", scores.score_rounding(F.col("value") / 7).alias("rounded")
    )


def _logits(spark, sf):
    """Three class scores from whole vectors: the sums of every third entry, rounded against float order."""

    def third(k: int):
        own = F.filter("embedding", lambda x, i: i % 3 == k)
        return F.round(F.aggregate(own, F.lit(0.0), lambda s, x: s + x.cast("double")), 9)

    return views.table(spark, sf, "embeddings").select("vec_id", F.array(*[third(k) for k in range(3)]).alias("logits"))


@query
def softmax_probabilities(spark, sf):
    p = scores.softmax(F.col("logits"))
    return _logits(spark, sf).withColumn("p", p).select(
        "vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)]
    )


@query
def softmax_label(spark, sf):
    return _logits(spark, sf).select(
        "vec_id", scores.class_label(scores.softmax(F.col("logits"))).alias("sentiment")
    )


@query
def model_input_words(spark, sf):
    """What a model limited to 128 word tokens is given, next to the length of the whole text."""
    tokens = text.word_tokens(F.col("body"))
    return views.wide_articles(spark, sf).select("id", tokens.alias("tokens")).select(
        "id",
        F.size("tokens").alias("n_tokens"),
        F.array_join(text.model_input(F.col("tokens")), " ").alias("model_input"),
    )


# ---- text operators


@query
def tag_columns(spark, sf):
    return tags.tag(views.wide_articles(spark, sf), PATTERNS).select("id", *PATTERNS)


@query
def exclusive_tags(spark, sf):
    flagged = tags.tag(views.wide_articles(spark, sf), PATTERNS).select("id", *PATTERNS)
    return tags.exclusive_tag(flagged, NAMES)


@query
def lexicon_score(spark, sf):
    return sentiment.lexicon_score(views.wide_articles(spark, sf), views.lexicon(spark))


@query
def lexicon_score_large(spark, sf):
    """The shuffled form, for a lexicon that grows with the tables."""
    articles = views.articles(spark, sf)  # the operator deals the texts
    return sentiment.lexicon_score_shuffled(articles, views.derived_lexicon(spark, sf))


@query
def classify_extremes(spark, sf):
    """Articles labelled by the quantiles of all article scores."""
    scored = sentiment.lexicon_score(views.wide_articles(spark, sf), views.lexicon(spark))
    scored = written_table(scored, "scores")
    return extremes.classify_extremes(scored, "score", 0.05, extremes.exact_quantiles(scored, "score"))


@query
def article_quantiles(spark, sf):
    return extremes.exact_quantiles(views.table(spark, sf, "events"), "value").drop("q")


@query
def dedup_incremental(spark, sf):
    """Two batches, one after the other, give what all rows at once give."""
    articles = views.articles(spark, sf).select("id", "title", "subtitle")
    middle = articles.agg(F.floor(F.avg("id"))).first()[0] or 0
    root = shared_path(spark, "batches")
    increments.append_batch(spark, root, articles.filter(F.col("id") <= middle), 1)
    increments.append_batch(spark, root, articles.filter(F.col("id") > middle), 2)
    return increments.read_batches(spark, root)


@query
def dedup_second_oldest(spark, sf):
    return dedup.dedup_second_oldest(views.articles(spark, sf))


# ---- frontier


def _newest_event(spark, sf):
    return frontier.high_water_mark(views.table(spark, sf, "events"), "ts")


@query
def frontier_dates(spark, sf):
    return frontier.front_page_dates(_newest_event(spark, sf), today=TODAY, base="https://news.example/frontpage/")


@query
def frontier_dates_fixed(spark, sf):
    """Days from a fixed start on that the events do not cover."""
    days = frontier.dates_since(spark, dt.date(2023, 12, 20), today=TODAY, base="https://news.example/frontpage/")
    seen = views.table(spark, sf, "events").select(dates.day(F.col("ts")).alias("date")).distinct()
    return days.join(F.broadcast(seen), "date", "left_anti")  # a day a row: the calendar bounds it


@query
def frontier_dates_none(spark, sf):
    """Nothing to fetch when the newest day lies after today."""
    return frontier.front_page_dates(_newest_event(spark, sf), today=dt.date(2023, 12, 1))


@query
def frontier_pending(spark, sf):
    links = views.stored_links(spark, sf)
    return frontier.pending(views.frontier(spark, sf, links), views.collected(links), BASE)


@query
def frontier_outcome(spark, sf):
    return _failed_nulled(spark, sf)


@query
def frontier_outcome_log(spark, sf):
    """The same from a log of two runs, compacted after the first; the frontier is not rewritten in between."""
    links = views.stored_links(spark, sf)
    outcomes, root = views.link_outcomes(links), shared_path(spark, "frontier-log")
    first = F.xxhash64("url") % 2 == 0
    frontier_log.append_run(spark, root, 1, views.frontier(spark, sf, links), outcomes.filter(first))
    frontier_log.compact(spark, root, 1)
    frontier_log.append_run(spark, root, 2, outcomes=outcomes.filter(~first))
    return frontier_log.current(spark, root)


@query
def grown_frontier(spark, sf):
    """Frontier plus the links of the front pages since the newest event; one page stands for each day."""
    day = F.expr("date_add(date'2024-01-01', cast(page_id as int))")
    fronts = views.pages(spark, sf).select(
        text.absolute_url("https://news.example/frontpage/", dates.day_path(day)).alias("url"), "html"
    )
    stored = views.table(spark, sf, "events").select(F.col("ts").alias("pubdate"))
    return collection.grow_frontier(
        stored, fronts, views.frontier(spark, sf), "https://news.example/frontpage/", TODAY, "li"
    )


def _collection_run(spark, sf):
    """All article pages are known, labelled ones are collected already, absolute ones are skipped."""
    markup = views.dealt(views.article_markup(spark, sf), "id").select("url", "html")
    known = frontier.new_entries(markup, RUN_DATE).unionByName(views.frontier(spark, sf))
    have = views.table(spark, sf, "labels").select(
        F.concat(F.lit("/story/"), F.col("doc_id").cast("string")).alias("url")
    )
    return collection.collect_articles(known, have, markup, BASE)


@query
def collected_articles(spark, sf):
    return _collection_run(spark, sf)[0]


@query
def frontier_after_collection(spark, sf):
    return _collection_run(spark, sf)[1]


# ---- model scores


@query
def score_missing_merge(spark, sf):
    scored = scoring.score_missing(views.scored_articles(spark, sf), scorer.letter_scorer)
    return scored.select("id", "url", "sentiment")


@query
def model_logits(spark, sf):
    """Class scores of unscored articles, before they become labels."""
    todo = scoring.unscored(views.scored_articles(spark, sf)).select("id", "body")
    scored = scoring.logits_of(todo, scorer.letter_scorer)
    return scored.select("id", *[F.col("logits")[i].cast("double").alias(f"class{i}") for i in range(3)])


# ---- analyses


@query
def weekly_label_share(spark, sf):
    return trends.weekly_label_share(views.articles(spark, sf))


@query
def author_daily_activity(spark, sf):
    return trends.author_daily_activity(views.articles(spark, sf), excluded=EXCLUDED, first_year=FIRST_YEAR)


@query
def exclusive_tag_sentiment(spark, sf):
    return sentiment_plans.exclusive_tag_sentiment(
        views.wide_articles(spark, sf), views.lexicon(spark), PATTERNS, NAMES
    )


@query
def term_sentiment_by_kicker(spark, sf):
    return sentiment_plans.term_sentiment_by_kicker(views.wide_articles(spark, sf), views.lexicon(spark), TERMS)


@query
def multi_column_tag_by_origin(spark, sf):
    return sentiment_plans.institution_sentiment_by_author(
        views.wide_articles(spark, sf), views.lexicon(spark), ANYWHERE
    )


@query
def prefix_tag_by_kicker(spark, sf):
    return sentiment_plans.person_sentiment_by_kicker(
        views.wide_articles(spark, sf), views.lexicon(spark), PREFIX
    )


@query
def market_articles_with_index(spark, sf):
    return sentiment_plans.market_articles_with_index(
        views.wide_articles(spark, sf),
        views.lexicon(spark),
        views.prices(spark, sf),
        MARKET,
    )


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
