import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.operators import counts, joins, tags
from newsloom.plans import trends


def frame(spark, labels):
    return spark.createDataFrame([(i, label) for i, label in enumerate(labels)], "id long, kicker string")


def test_ties_go_by_label_and_null_comes_last(spark):
    df = frame(spark, ["b", "b", "a", "a", None, None, "c"])
    assert [tuple(r) for r in counts.top_k(df, "kicker", 3).collect()] == [("a", 2), ("b", 2), (None, 2)]
    assert [r[0] for r in counts.top_k(df, "kicker", 2).collect()] == ["a", "b"]


def test_null_label_is_a_member(spark):
    df = frame(spark, [None, None, "a", "b"])
    lumped = counts.lump(df, counts.top_k(df, "kicker", 1), "kicker", "new_kicker")
    assert sorted(r["new_kicker"] or "" for r in lumped.collect()) == ["", "", "sonstiges", "sonstiges"]
    assert counts.keep_top(df, counts.top_k(df, "kicker", 1), "kicker").count() == 2


labels = st.lists(st.sampled_from(["a", "b", "c", "sonstiges", "", None]), min_size=1, max_size=30)


@settings(max_examples=6, deadline=None)
@given(labels, st.integers(1, 4))
def test_lumping_keeps_every_row(spark, names, k):
    df = frame(spark, names)
    lumped = counts.lump(df, counts.top_k(df, "kicker", k), "kicker", "new_kicker")
    assert sorted(r["id"] for r in lumped.collect()) == list(range(len(names)))


def test_exclusion_comes_after_the_limit(spark):
    df = frame(spark, ["", "", "", "a", "a", "b"])
    assert [r[0] for r in counts.exclude(counts.top_k(df, "kicker", 2), "kicker", [""]).collect()] == ["a"]


def test_exclusion_keeps_null(spark):
    assert counts.exclude(frame(spark, [None, "x"]), "kicker", ["x"]).count() == 1


def dated(spark, rows):
    return spark.createDataFrame(
        [(i, k, o, dt.datetime.fromisoformat(d)) for i, (k, o, d) in enumerate(rows)],
        "id long, kicker string, origins string, pubdate timestamp_ntz",
    )


def test_weekly_shares(spark):
    df = dated(
        spark,
        [("a", "", "2023-04-02 10:00:00"), ("a", "", "2023-04-03 00:00:00"), ("b", "", "2023-04-09 23:59:00"),
         ("b", "", "2023-04-05 00:00:00"), ("sonstiges", "", "2023-04-05 00:00:00"), (None, "", "2023-04-05 00:00:00")],
    )
    got = {(str(r.week), r.new_kicker): (r.n, r.percentage) for r in trends.weekly_label_share(df).collect()}
    assert got == {
        ("2023-03-27", "a"): (1, 1.0),
        ("2023-04-03", "a"): (1, pytest.approx(1 / 3)),
        ("2023-04-03", "b"): (2, pytest.approx(2 / 3)),
    }


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(1, 28)), min_size=1, max_size=25))
def test_shares_of_a_week_sum_to_one(spark, found):
    df = dated(spark, [(label, "", f"2023-05-{day:02d} 00:00:00") for label, day in found])
    totals = {}
    for r in trends.weekly_label_share(df, k=3).collect():
        totals[r.week] = totals.get(r.week, 0) + r.percentage
    assert all(total == pytest.approx(1.0) for total in totals.values())


def test_shares_with_a_null_parent(spark, rows):
    df = spark.createDataFrame([(None, 1), (None, 3), ("w", 2)], "week string, n long")
    assert rows(counts.share_within(df, "n", "week"), "percentage") == [(0.25,), (0.75,), (1.0,)]


def test_author_activity(spark, rows):
    df = dated(
        spark,
        [("", "ann", "2001-12-31 10:00:00"), ("", "ann", "2002-01-01 00:00:00"), ("", "APA", "2003-01-01 00:00:00"),
         ("", None, "2003-01-01 00:00:00"), ("", "ann", "2002-01-01 08:00:00")],
    )
    got = rows(trends.author_daily_activity(df).withColumn("day", counts.F.col("day").cast("string")))
    assert got == [("2002-01-01", "ann", 2), ("2003-01-01", None, 1)] or got == [
        ("2003-01-01", None, 1), ("2002-01-01", "ann", 2)
    ]


def test_articles_are_scanned_once(spark, sf_dir):
    from newsloom.registry.queries import queries

    for name in ("weekly_label_share", "author_daily_activity"):
        df = queries()[name](spark, sf_dir)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_tags(spark):
    df = spark.createDataFrame([(1, "x y"), (2, "x"), (3, None), (4, "z")], "id long, body string")
    flagged = tags.tag(df, {"fx": "x", "fy": "y"})
    assert [(r.fx, r.fy) for r in flagged.orderBy("id").collect()] == [
        (True, True), (True, False), (False, False), (False, False),
    ]
    only = tags.exclusive_tag(flagged, {"fx": "X", "fy": "Y"})
    assert [tuple(r) for r in only.collect()] == [(2, "x", "X")]
    assert [r.n for r in flagged.select(tags.tag_count(["fx", "fy"]).alias("n")).collect()] == [2, 1, 0, 0]


def test_repeat_rows_unfolds_in_chunks(spark):
    df = spark.createDataFrame([("a", 25), ("b", 1), ("c", 0), (None, 10)], "k string, n long")
    got = counts.count_by(joins.repeat_rows(df, "n", chunk=10), "k").collect()
    assert {r.k: r.n for r in got} == {"a": 25, "b": 1, None: 10}


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_checked_join_agrees_with_a_plain_join(spark, rows, monkeypatch, how):
    big = spark.createDataFrame([("hot", 1)] * 30 + [("a", 1), ("b", 2), (None, 3), (None, 3)], "url string, d int")
    small = spark.createDataFrame([("hot", True), ("b", False)], "url string, f boolean")
    expected = rows(big.join(small, "url", how))
    assert rows(joins.join_checked(big, small, "url", how)) == expected
    monkeypatch.setattr(joins, "fits_broadcast", lambda _: False)
    assert rows(joins.join_checked(big, small, "url", how)) == expected
    assert rows(joins.join_checked(big, small, "url", how, collapse=True)) == expected
    assert rows(joins.salted_join(big, small, "url", counts.F.col("d"), how)) == expected
