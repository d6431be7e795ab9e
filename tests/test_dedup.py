import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.operators import dedup, joins
from newsloom.sources import increments

SCHEMA = "id long, title string, subtitle string, body string"


def two_deletes(rows):
    """Delete the oldest of every duplicated group, then all but the oldest of what is left."""
    left = list(rows)
    for only_duplicated in (True, False):
        groups = defaultdict(list)
        for row in left:
            groups[row[1:3]].append(row)
        left = []
        for members in groups.values():
            members.sort()
            if only_duplicated:
                left += members[1:] if len(members) > 1 else members
            else:
                left.append(members[0])
    return sorted(left)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("copies, kept", [(1, 1), (2, 2), (3, 2), (5, 2)])
def test_second_oldest_stays(spark, rows, copies, kept):
    df = frame(spark, [(i, "t", None, f"b{i}") for i in range(1, copies + 1)] + [(9, "t", "", "x")])
    assert rows(dedup.dedup_second_oldest(df), "id") == [(kept,), (9,)]


titles = st.sampled_from(["a", "b", "", None])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(titles, titles), min_size=1, max_size=25))
def test_equals_two_deletes(spark, keys):
    data = [(i, t, s, f"b{i}") for i, (t, s) in enumerate(keys)]
    got = sorted(tuple(r) for r in dedup.dedup_second_oldest(frame(spark, data)).collect())
    assert got == two_deletes(data)


def test_steps_one_by_one_equal_the_net_rule(spark, rows):
    data = [(i, t, None, "b") for i, t in enumerate("aababcad")]
    df = frame(spark, data)
    stepwise = dedup.keep_oldest(dedup.delete_oldest_duplicate(df))
    assert rows(stepwise) == rows(dedup.dedup_second_oldest(df))


def test_is_idempotent(spark, rows):
    once = dedup.dedup_second_oldest(frame(spark, [(i, "ab"[i % 2], "s", "b") for i in range(7)]))
    assert rows(dedup.dedup_second_oldest(once)) == rows(once)


def test_shuffled_form_gives_the_same(spark, rows, monkeypatch):
    df = frame(spark, [(i, "hot" if i % 3 else f"t{i}", "s", "b") for i in range(60)])
    expected = rows(dedup.dedup_second_oldest(df))
    monkeypatch.setattr("newsloom.operators.joins.fits_broadcast", lambda *a, **b: False)
    assert rows(dedup.dedup_second_oldest(df)) == expected


def test_ids_are_shuffled_once(spark, tmp_path):
    frame(spark, [(i, f"t{i % 7}", None, "b") for i in range(20)]).write.parquet(str(tmp_path / "a"))
    df = spark.read.parquet(str(tmp_path / "a"))
    two = dedup.smallest_ids(df, dedup.KEYS, "id", 2).groupBy(*dedup.KEYS).agg(F.max("id").alias("_stays"), F.count(F.lit(1)).alias("_rows"))
    assert two._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    plan = dedup.dedup_second_oldest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def increments_of(spark, root, batches):
    for n, batch in enumerate(batches):
        increments.append_batch(spark, root, frame(spark, batch), n)
    return sorted((tuple(r) for r in increments.read_batches(spark, root).collect()), key=str)


@pytest.mark.parametrize("fits", [True, False])
def test_batches_give_what_all_rows_give(spark, tmp_path, monkeypatch, fits):
    rng = random.Random(4)
    data = [(i, rng.choice(["a", "b", "c", None, f"t{i}"]), rng.choice(["x", None]), f"b{i}") for i in range(90)]
    if not fits:
        monkeypatch.setattr("newsloom.operators.joins.fits_broadcast", lambda *a, **b: False)
    cuts = [0, 1, 3, 20, 20, 60, 90]
    got = increments_of(spark, str(tmp_path), [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    assert got == sorted(two_deletes_null_safe(data), key=str)


def two_deletes_null_safe(data):
    groups = defaultdict(list)
    for row in data:
        groups[row[1:3]].append(row)
    return [sorted(g, key=lambda r: r[0])[min(1, len(g) - 1)] for g in groups.values()]


def test_batches_out_of_order_are_refused(spark, tmp_path):
    root = str(tmp_path)
    increments.append_batch(spark, root, frame(spark, [(5, "t", "s", "x"), (None, "t", "s", "y")]), 1)
    with pytest.raises(ValueError, match="larger"):
        increments.append_batch(spark, root, frame(spark, [(4, "t", "s", "x")]), 2)
    with pytest.raises(ValueError, match="batch 1"):
        increments.append_batch(spark, root, frame(spark, [(9, "t", "s", "x")]), 1)
    increments.append_batch(spark, root, frame(spark, [(6, "t", "s", "z"), (7, "t", "s", "w")]), 2)
    assert sorted(str(r.id) for r in increments.read_batches(spark, root).collect()) == ["6", "None"]


def test_small_sides_are_measured_with_all_their_columns(spark):
    df = spark.createDataFrame([(bytearray(1000), [1] * 100, {"a": "b" * 500}, "c" * 100)] * 10, "b binary, a array<int>, m map<string,string>, s string")
    assert joins.fits_broadcast(df, max_bytes=40_000)
    for column, size in (("b", 9000), ("a", 7000), ("m", 4500), ("s", 900)):
        assert not joins.fits_broadcast(df.select(column), max_bytes=size)


def test_hot_groups_shrink_before_the_shuffle(spark):
    plan = dedup.surviving_ids(frame(spark, [(1, "t", "s", "b")]))._jdf.queryExecution().executedPlan().toString()
    limit, exchange = plan.index("Partial", plan.index("WindowGroupLimit")), plan.index("Exchange")
    assert plan.count("WindowGroupLimit") == 2 and limit > exchange
    assert "body" not in plan.split("Exchange")[1].split("Scan")[0]


def test_rows_without_id_stay_at_any_size(spark, monkeypatch):
    df = frame(spark, [(1, "t", "s", "x"), (2, "t", "s", "x"), (None, "t", "s", "x"), (3, "u", "s", "x")])
    kept = spark.createDataFrame([(2,), (3,)], "id long")
    results = []
    for fits in (True, False):
        monkeypatch.setattr("newsloom.operators.joins.fits_broadcast", lambda *a, fits=fits, **b: fits)
        results.append(sorted(str(r.id) for r in dedup.keep_ids(df, kept).collect()))
    assert results == [["2", "3", "None"]] * 2
