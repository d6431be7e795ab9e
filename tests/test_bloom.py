import pytest
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators import bloom, frontier


def addresses(spark, start, end):
    return spark.range(start, end).select(F.concat(F.lit("/story/"), "id").alias("url"))


def test_no_key_is_missed_and_few_others_pass(spark):
    known, blocks = addresses(spark, 0, 20_000), bloom.bloom_blocks(20_000)
    filter_ = bloom.bloom_filter(known, "url", blocks)
    assert filter_.count() <= blocks
    marked = bloom.with_membership(addresses(spark, 0, 120_000).withColumn("known", F.lit(1)), "url", filter_, blocks)
    assert marked.columns == ["url", "known", "_maybe"]
    inside = F.split_part("url", F.lit("/"), F.lit(3)).cast("int") < 20_000
    found = {r[0]: r[1] for r in marked.groupBy(inside).agg(F.avg(F.col("_maybe").cast("int"))).collect()}
    assert found[True] == 1 and found[False] < 0.01


@pytest.mark.parametrize("known", [[], [None], ["/a", "/a", "/c", None]])
@pytest.mark.parametrize("filter_fits", [True, False])
def test_rows_left_are_exact(spark, rows, monkeypatch, known, filter_fits):
    df = spark.createDataFrame([("/a", None, 0), ("/a", None, 0), ("/b", None, 1), ("/b", None, 1), (None, None, 2)], schemas.FRONTIER)
    stored = spark.createDataFrame([(u,) for u in known], "url string")
    if not filter_fits:
        monkeypatch.setattr(bloom, "fits_broadcast", lambda *a, **b: False)
    want = [r for r in df.collect() if r["url"] not in set(known) - {None}]
    assert rows(bloom.without_keys(df, stored, "url")) == rows(spark.createDataFrame(want, schemas.FRONTIER))
    monkeypatch.setattr(frontier, "fits_broadcast", lambda *a, **b: False)
    assert rows(frontier.not_collected(df, stored)) == rows(spark.createDataFrame(want, schemas.FRONTIER))


def test_rows_that_are_ruled_out_do_not_move(spark, tmp_path, monkeypatch):
    addresses(spark, 0, 5000).write.parquet(str(tmp_path / "known"))
    addresses(spark, 4900, 60_000).withColumn("n", F.lit(1)).write.parquet(str(tmp_path / "rows"))
    known, df = spark.read.parquet(str(tmp_path / "known")), spark.read.parquet(str(tmp_path / "rows"))
    monkeypatch.setattr("newsloom.operators.joins.BROADCAST_ROWS", 0)
    left = bloom.without_keys(df, known, "url")
    plan = left._jdf.queryExecution().sparkPlan().toString()
    sure, maybe = plan.split("SortMergeJoin", 1)[0], plan
    assert plan.count("FileScan parquet [url") >= 2 and "Union" in sure and "HashAggregate" in maybe
    assert left.count() == 55_000
    # what reaches the exact join is what the filter lets pass
    blocks = bloom.bloom_blocks(5000)
    passing = bloom.with_membership(df, "url", bloom.bloom_filter(known, "url", blocks), blocks).filter("_maybe").count()
    assert 100 <= passing < 700
