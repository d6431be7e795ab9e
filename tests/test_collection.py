import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom import schemas, session
from newsloom.operators import frontier, scoring
from newsloom.plans import collection
from newsloom.sources import frontier_log, sinks
from test_pages import page

DAY = dt.date(2023, 4, 1)


def known(spark, rows):
    return spark.createDataFrame(rows, schemas.FRONTIER)


def newest(spark, day):
    return spark.createDataFrame([(day,)], "newest date")


def test_days_run_to_the_day_after_today(spark):
    days = frontier.front_page_dates(newest(spark, DAY), today=dt.date(2023, 4, 3), base="https://n.example/f/")
    assert [tuple(map(str, r)) for r in days.collect()] == [
        (f"2023-04-0{i}", f"https://n.example/f/2023/04/0{i}") for i in (2, 3, 4)
    ]


@pytest.mark.parametrize("today, count", [(DAY, 1), (dt.date(2023, 3, 31), 0), (dt.date(2022, 1, 1), 0)])
def test_days_at_the_edge(spark, today, count):
    assert frontier.front_page_dates(newest(spark, DAY), today=today).count() == count


def test_newest_of_times_kept_as_text(spark):
    kept = spark.createDataFrame([("2023-04-01 08:00:00",), ("2023-04-02 07:59:59",), ("2024-13-01 00:00:00",), (None,)], "pubdate string")
    assert frontier.high_water_mark(kept).first()[0] == dt.datetime(2023, 4, 2, 7, 59, 59)


def test_no_articles_no_days(spark):
    assert frontier.front_page_dates(newest(spark, None), today=DAY).count() == 0


def test_days_from_a_fixed_start(spark):
    assert frontier.dates_since(spark, DAY, today=dt.date(2023, 4, 10)).count() == 10


def test_older_frontier_is_completed(spark):
    old = spark.createDataFrame([("/a",)], "url string")
    assert [tuple(r) for r in frontier.as_frontier(old).collect()] == [("/a", None, 0)]


def test_older_frontier_stays_to_do(spark, rows):
    older = spark.createDataFrame([("/b",)], "url string")
    both = frontier.append_frontier(known(spark, [("/a", DAY, 1)]), older)
    assert rows(frontier.todo(both), "url") == [("/b",)]


def test_pending(spark, rows):
    table = known(spark, [(None, DAY, 0), ("/a", DAY, 0), ("/a", DAY, 0), ("/b", DAY, 0), ("https://n.example/live", DAY, 0)])
    done = spark.createDataFrame([("/b",), (None,)], "url string")
    assert rows(frontier.pending(table, done, "https://n.example"), "url") == [("/a",), ("/a",)]


def test_outcomes(spark, rows):
    table = known(spark, [("/ok", DAY, 0), ("/bad", DAY, 0), ("/bad", DAY, 0), ("/bad", DAY, 1), ("/new", DAY, 0), (None, DAY, 2), ("/ok", DAY, 2)])
    results = spark.createDataFrame([("/ok", False), ("/bad", True)], "url string, failed boolean")
    got = rows(frontier.apply_outcomes(table, results), "url", "downloaded")
    assert got == [(None, 1), (None, 2), (None, 2), (None, 2), ("/new", 0), ("/ok", 1), ("/ok", 2)]


def test_frontier_grows_by_links_of_new_days(spark, rows):
    articles = spark.createDataFrame([(1, dt.datetime(2023, 4, 1, 8))], "id long, pubdate timestamp_ntz")
    pages = spark.createDataFrame(
        [("f/2023/04/01", "<article><a href=/old>"), ("f/2023/04/02", "<article><a href=/x></article><article><a href=/x>"),
         ("f/2023/04/03", "<article><a href=/y>"), ("f/2023/04/04", "<article><a href=/z>")],
        "url string, html string",
    )
    old = known(spark, [("/x", DAY, 1)])
    grown = collection.grow_frontier(articles, pages, old, "f/", today=dt.date(2023, 4, 2))
    assert rows(grown) == sorted(
        [("/x", DAY, 1), ("/x", dt.date(2023, 4, 2), 0), ("/x", dt.date(2023, 4, 2), 0), ("/y", dt.date(2023, 4, 2), 0)], key=str
    )


def test_collection_run_and_rerun(spark, rows):
    base = "https://n.example"
    table = known(
        spark,
        [("/a", DAY, 0), ("/twice", DAY, 0), ("/twice", DAY, 0), ("/bad", DAY, 0), ("/missing", DAY, 0), ("/had", DAY, 0),
         (base + "/live", DAY, 0), ("/done", DAY, 1)],
    )
    pages = spark.createDataFrame(
        [("/a", page()), ("/twice", page(origins="")), ("/bad", page(time="x")), ("/had", page()), ("/done", page())],
        schemas.PAGES,
    )
    have = spark.createDataFrame([("/had",)], "url string")
    new, after = collection.collect_articles(table, have, pages, base)
    assert rows(new, "url", "origins") == [("/a", "APA, red"), ("/twice", ""), ("/twice", "")]
    assert rows(after, "url", "downloaded") == [
        (None, 2), ("/a", 1), ("/done", 1), ("/had", 0), ("/missing", 0), ("/twice", 1), ("/twice", 1), (base + "/live", 0),
    ]
    have = have.union(new.select("url"))
    again, last = collection.collect_articles(after, have, pages, base)
    assert again.count() == 0 and rows(last) == rows(after)
    arrived = pages.union(spark.createDataFrame([("/missing", page())], schemas.PAGES))
    late, after = collection.collect_articles(last, have, arrived, base)
    assert rows(late, "url") == [("/missing",)] and ("/missing", 1) in rows(after, "url", "downloaded")


def test_the_newest_page_of_an_address_counts(spark, rows):
    table = known(spark, [("/a", DAY, 0), ("/b", DAY, 0), ("/c", DAY, 0), ("/c", DAY, 0)])
    none = spark.createDataFrame([], "url string")
    pages = spark.createDataFrame(
        [("/a", page(origins=""), 1), ("/a", page(), 3), ("/a", page(time="x"), 2), ("/b", page(), 1), ("/b", page(time="x"), 2), ("/c", page(), 1), ("/c", page(), 1)],
        "url string, html string, fetched int",
    )
    new, after = collection.collect_articles(table, none, pages, "://", newest="fetched")
    assert rows(new, "url", "origins") == [("/a", "APA, red"), ("/c", "APA, red"), ("/c", "APA, red")]
    assert rows(after, "url", "downloaded") == [(None, 2), ("/a", 1), ("/c", 1), ("/c", 1)]
    # without an order one page of each address counts, always the same
    some, _ = collection.collect_articles(table, none, pages, "://")
    more, _ = collection.collect_articles(table, none, pages.repartition(5).orderBy(F.desc("fetched")), "://")
    assert rows(some) == rows(more) and some.groupBy("url").count().filter("count > 2").count() == 0


def test_log_gives_what_rewriting_gives(spark, rows, tmp_path):
    """Random runs: addresses come back, outcomes differ, the log is compacted now and then."""
    draw, root = random.Random(9), str(tmp_path)
    urls = [f"/{k}" for k in range(12)]
    whole = known(spark, [])
    for run in range(1, 7):
        found = known(spark, [(draw.choice([*urls, None]), DAY, draw.choice([0, 0, 1])) for _ in range(8)])
        came = spark.createDataFrame([(u, draw.random() < 0.3) for u in draw.sample(urls, 4)], frontier_log.OUTCOMES)
        whole = session.written_table(frontier.apply_outcomes(frontier.append_frontier(whole, found), came))
        frontier_log.append_run(spark, root, run, found, came)
        assert rows(frontier_log.current(spark, root)) == rows(whole)
        if run in (2, 5):
            frontier_log.compact(spark, root, run)
            assert rows(frontier_log.current(spark, root)) == rows(whole)
    with pytest.raises(ValueError, match="compacted"):
        frontier_log.append_run(spark, root, 5, whole)
    assert frontier_log.current(spark, str(tmp_path / "none")).count() == 0


def test_models_get_texts_of_like_size(spark, sf_dir):
    texts = [r[0] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    sizes = [scoring.word_count(t) for t in texts]
    given = [list(range(k, min(k + 32, len(texts)))) for k in range(0, len(texts), 32)]
    like = scoring.like_sized(texts, 32)
    assert sorted(i for b in like for i in b) == list(range(len(texts)))
    assert scoring.padded(sizes, like) < 0.5 * scoring.padded(sizes, given)


def test_scores_come_back_in_order(spark):
    rows = [(i, None if i % 11 == 0 else "x" * (i * 37 % 101)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, body string").repartition(3)
    load = lambda: lambda texts: [[len(t), len(texts), 0] for t in texts]
    got = {r["id"]: r["logits"] for r in scoring.logits_of(df, load, rows=7, size=len).collect()}
    assert all(got[i][0] == len(t or "") and got[i][1] <= 7 for i, t in rows)


# a lambda travels to the workers by value, unlike a function of this test module
letters = lambda: lambda texts: [(0.1, t.count("g"), t.count("s")) for t in texts]


def test_model_scores_only_what_is_missing(spark, rows):
    df = spark.createDataFrame([(1, "ggs", None), (2, "ss", None), (3, "gg", -1.0), (4, None, None)], "id long, body string, sentiment double")
    once = collection.model_sentiment(df, letters)
    assert rows(once, "id", "sentiment") == [(1, 1.0), (2, -1.0), (3, -1.0), (4, 0.0)]
    assert rows(collection.model_sentiment(once, letters)) == rows(once)


def test_model_scores_a_table_without_the_column(spark, rows):
    df = spark.createDataFrame([(1, "g")], "id long, body string")
    assert rows(collection.model_sentiment(df, letters)) == [(1, "g", 1.0)]


def test_update_by_key(spark, rows):
    df = spark.createDataFrame([(1, None), (2, 1.0), (3, 0.0)], "id long, sentiment double")
    new = spark.createDataFrame([(1, -1.0), (1, -2.0), (1, None), (2, None)], "id long, sentiment double")
    assert rows(scoring.update_by_key(df, new)) == [(1, -1.0), (2, None), (3, 0.0)]


def test_clean_articles(spark):
    df = spark.createDataFrame([(1, "t", "s"), (2, "t", "s"), (3, "u", "s")], "id long, title string, subtitle string")
    assert sorted(r.id for r in collection.clean_articles(df).collect()) == [2, 3]


def test_forgetting_an_address_keeps_null(spark):
    df = known(spark, [("/a", DAY, 0), (None, DAY, 2), ("/b", DAY, 0)])
    assert sorted(str(r.url) for r in frontier.forget_url(df, "/a").collect()) == ["/b", "None"]


def test_store_articles_continues_keys(spark, tmp_path):
    name = "stored_" + tmp_path.name.replace("-", "_")
    pages = spark.createDataFrame([(f"/{i}", page()) for i in range(5)], schemas.PAGES)
    table = known(spark, [(f"/{i}", DAY, 0) for i in range(5)])
    empty = spark.createDataFrame([], "url string")
    new, _ = collection.collect_articles(table, empty, pages, "://")
    for _ in range(2):
        collection.store_articles(spark, name, str(tmp_path / "articles"), new)
    stored = spark.table(name)
    assert sorted(r.id for r in stored.select("id").collect()) == list(range(1, 11))
    assert stored.agg(F.max("pubdate")).first()[0] == dt.datetime(2023, 5, 1, 12, 34)
    spark.sql(f"DROP TABLE {name}")


def test_html_of_bucketed_pages_does_not_move(spark, tmp_path, monkeypatch):
    name = "pages_" + tmp_path.name.replace("-", "_")
    sinks.create_if_absent(spark, name, str(tmp_path / "pages"), schemas.PAGES, bucketed_by="url", buckets=4)
    spark.createDataFrame([(f"/{i}", page()) for i in range(20)], schemas.PAGES).write.insertInto(name)
    monkeypatch.setattr("newsloom.operators.joins.fits_broadcast", lambda *a, **b: False)
    plans = []
    write = collection.written_table
    monkeypatch.setattr(collection, "written_table", lambda df, n: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, n))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = known(spark, [(f"/{i}", DAY, 0) for i in range(10)])
        new, _ = collection.collect_articles(table, spark.createDataFrame([], "url string"), spark.table(name), "://")
        assert new.count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    parsed = next(p for p in plans if "SelectedBucketsCount" in p)
    assert all("html" not in line and "body" not in line for line in parsed.splitlines() if "Exchange" in line)
    spark.sql(f"DROP TABLE {name}")
