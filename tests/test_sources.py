import datetime as dt

import pandas as pd
import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark.sql import functions as F

from newsloom import schemas, session
from newsloom.operators import dedup, scoring
from newsloom.operators.keys import next_key, number_rows
from newsloom.sources import feather, sinks, tables

DAY = dt.date(2023, 4, 1)


def frontier(spark):
    return spark.createDataFrame([("/a,b", DAY, 0), ('/"q"', DAY, 1), (None, None, 2)], schemas.FRONTIER)


def test_csv_round_trip(spark, rows, tmp_path):
    sinks.write_csv(frontier(spark), str(tmp_path / "f"))
    assert rows(tables.read_csv(spark, str(tmp_path / "f"), schemas.FRONTIER)) == rows(frontier(spark))


def test_csv_is_read_by_name(spark, rows, tmp_path):
    path = str(tmp_path / "old.csv")
    pd.DataFrame({"downloaded": [0, 1], "url": ["/a", "/b"], "more": [1, 2]}).to_csv(path)
    got = tables.read_csv(spark, path, schemas.FRONTIER, ["url", "datum", "downloaded"])
    assert rows(got) == [("/a", None, 0), ("/b", None, 1)]


def test_csv_with_line_breaks(spark, rows, tmp_path):
    df = spark.createDataFrame([("a\nb", 1.0)], schemas.LEXICON)
    sinks.write_csv(df, str(tmp_path / "f"))
    assert rows(tables.read_csv(spark, str(tmp_path / "f"), schemas.LEXICON, multi_line=True)) == [("a\nb", 1.0)]


def test_feather_round_trip(spark, rows, tmp_path):
    path = str(tmp_path / "f")
    df = frontier(spark).repartition(3)
    feather.write_feather(df, path)
    feather.write_feather(df, path)
    assert feather.read_feather(spark, path).count() == 6
    feather.write_feather(df, path, mode="overwrite")
    back = feather.read_feather(spark, path)
    assert rows(back) == rows(frontier(spark)) and back.schema == schemas.FRONTIER


def test_feather_written_by_pandas(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(feather, "WHOLE_FILE_BYTES", 10)
    path = str(tmp_path / "urls.feather")
    table = pa.table({"index": list(range(5000)), "url": [f"/{i}" for i in range(5000)]})
    pyarrow.feather.write_feather(table, path, chunksize=100)
    got = feather.read_feather(spark, path, schemas.FRONTIER)
    assert got.rdd.getNumPartitions() > 1
    assert got.filter(F.col("datum").isNull()).count() == 5000
    assert got.select("url").distinct().count() == 5000
    assert feather.read_feather(spark, path).columns == ["index", "url"]


def test_large_feather_files_are_split(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    monkeypatch.setattr(feather, "WHOLE_FILE_BYTES", 10)
    feather.write_feather(spark.range(100).repartition(4), path)
    assert feather.read_feather(spark, path).agg(F.sum("id")).first()[0] == 4950


def test_feather_reads_every_file_and_column(spark, tmp_path):
    feather.write_feather(spark.range(3), str(tmp_path / "f"))
    feather.write_feather(spark.range(3).withColumn("more", F.lit("x")), str(tmp_path / "f" / "sub"))
    for n, file in enumerate(sorted((tmp_path / "f" / "sub").glob("*.feather"))):
        file.rename(tmp_path / "f" / f"other{n}.arrow")
    got = feather.read_feather(spark, str(tmp_path / "f"))
    assert sorted(got.columns) == ["id", "more"] and got.count() == 6 and got.filter("more = 'x'").count() == 3
    (tmp_path / "none").mkdir()
    assert feather.read_feather(spark, str(tmp_path / "none"), got.schema).count() == 0


def test_csv_files_with_different_headers(spark, rows, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "new.csv").write_text("url,datum,downloaded\n/a,2024-01-02,1\n")
    (tmp_path / "c" / "old.csv").write_text(",url\n0,/b\n1,/c\n")
    got = tables.read_csv(spark, str(tmp_path / "c"), schemas.FRONTIER)
    assert rows(got, "url", "downloaded") == [("/a", 1), ("/b", None), ("/c", None)]


def test_newest_version_counts_even_without_rows(spark, tmp_path):
    root = str(tmp_path / "v")
    sinks.write_version(spark.range(4), root, 9)
    sinks.write_version(spark.range(0).withColumn("more", F.lit(1)), root, 10)
    latest = sinks.read_latest(spark, root)
    assert latest.columns == ["id", "more"] and latest.count() == 0


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    base = spark.range(20).select("id", F.lit(0).alias("v"), (F.col("id") % 4).cast("string").alias("part"))
    sinks.create_if_absent(spark, "rewritten", str(tmp_path / "t"), base.schema, ["part"])
    base.write.insertInto("rewritten")
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    changes = spark.createDataFrame([(1, 5, "1"), (1, 7, "1")], "id long, v int, part string")
    sinks.rewrite_partitions(spark, "rewritten", changes, "part", lambda rows, new: scoring.update_by_key(rows, new, column="v"))
    after = files()
    assert {f for f in before if f not in after and "part=1" in str(f)} and all(after[f] == t for f, t in before.items() if "part=1" not in str(f))
    assert spark.table("rewritten").count() == 20 and spark.table("rewritten").filter("v = 7").count() == 1
    spark.sql("DROP TABLE rewritten")


def test_csv_of_many_layouts(spark, rows, tmp_path):
    """Plain and compressed files at two depths, hidden and empty ones, in one scan; the driver opens none."""
    folder = tmp_path / "many"
    (folder / "deep").mkdir(parents=True)
    want = []
    for i in range(300):
        at = folder / ("deep" if i % 2 else "") / f"f{i:03}.csv"
        url = f'/story "{i}", more'
        layout = i % 3
        frame = {"url": [url], "datum": [DAY], "downloaded": [i]}
        if layout == 0:
            pd.DataFrame(frame).to_csv(at, index=False)
        elif layout == 1:
            pd.DataFrame({"downloaded": [i], "other": ["x"], "url": [url]}).to_csv(at)  # with an index
        else:
            pd.DataFrame(frame).to_csv(f"{at}.gz", index=False)
        want.append((url, None if layout == 1 else DAY, i))
    (folder / "empty.csv").write_text("")
    (folder / "bare.csv").write_text("url,datum,downloaded\n")
    (folder / "_hidden.csv").write_text("url\n/no\n")
    (folder / "blank.csv").write_text("\n \n\ufeffurl,downloaded\n/late,7\nurl,downloaded\n")
    got = tables.read_csv(spark, str(folder), schemas.FRONTIER)
    assert rows(got) == rows(spark.createDataFrame([*want, ("/late", None, 7), ("url", None, None)], schemas.FRONTIER))
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Scan csv") == 1 and "Union" not in plan


def test_csv_headers_over_lines(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text('"two\nlines",url\nx,"/a\nb"\n')
    (tmp_path / "b.csv").write_text('url,"two\nlines"\n/c,y\n')
    (tmp_path / "c.csv").write_text('"two\nother",url\n/no,/d\n')
    got = tables.read_csv(spark, str(tmp_path), schemas.FRONTIER, ["url"], multi_line=True)
    assert rows(got) == [("/a\nb",), ("/c",), ("/d",)]


def test_csv_of_a_known_header(spark, rows, tmp_path):
    (tmp_path / "a.csv").write_text("n,url\n1,/a\n2\n3,/c,more\n")
    got = tables.read_csv(spark, str(tmp_path), schemas.FRONTIER, ["url"], header=["n", "url"])
    assert rows(got) == [(None,), ("/a",), ("/c",)]
    (tmp_path / "none").mkdir()
    assert rows(tables.read_csv(spark, str(tmp_path / "none"), schemas.FRONTIER)) == []


@pytest.fixture
def parted(spark, tmp_path):
    """A table of two partition levels with a null partition, and what its files and partitions are."""
    values = [(i, i * 10, ("a", "it's", None)[i % 3], i % 2) for i in range(30)]
    rows = spark.createDataFrame(values, "id long, v long, part string, half int")
    sinks.create_if_absent(spark, "parted", str(tmp_path / "p"), rows.schema, ["part", "half"])
    rows.write.insertInto("parted")
    yield values, lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "p").rglob("*.parquet")}
    spark.sql("DROP TABLE parted")


def test_emptied_partitions_go(spark, rows, parted, tmp_path):
    values, files = parted
    before = files()
    for part, half in (("it's", 0), (None, 1)):
        named = spark.createDataFrame([(part, half)], "part string, half int")
        sinks.rewrite_partitions(spark, "parted", named, ["part", "half"], lambda old, new: old.filter("false"))
    left = [r for r in values if (r[2], r[3]) not in (("it's", 0), (None, 1))]
    assert rows(spark.table("parted")) == rows(spark.createDataFrame(left, spark.table("parted").schema))
    assert spark.read.parquet(str(tmp_path / "p")).count() == len(left)
    assert spark.sql("SHOW PARTITIONS parted").count() == 4
    after = files()
    assert len(after) < len(before) and all(before[f] == t for f, t in after.items())


def test_rows_that_move_join_those_that_stay(spark, rows, parted):
    values, files = parted
    before = files()

    def change(old, new):
        return old.withColumn("part", F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "new").otherwise(F.col("part")))

    sinks.rewrite_partitions(spark, "parted", spark.createDataFrame([(None,)], "part string"), "part", change)
    want = [(i, v, p if p is not None else "a" if i % 4 == 0 else "new" if i % 4 == 1 else None, h) for i, v, p, h in values]
    assert rows(spark.table("parted")) == rows(spark.createDataFrame(want, spark.table("parted").schema))
    after = files()
    # what the gaining partitions held stays in its files
    assert all(f in after and after[f] == t for f, t in before.items() if "__HIVE_DEFAULT" not in str(f))


def test_partitions_that_are_not_there(spark, rows, parted):
    values, files = parted
    before = files()
    sinks.rewrite_partitions(spark, "parted", spark.createDataFrame([("none",)], "part string"), "part", lambda old, new: old)
    assert files() == before and spark.table("parted").count() == len(values)


def test_lexicon_files(spark, rows, tmp_path):
    df = spark.createDataFrame([("gut", 0.5), ("schlecht", -0.5)], schemas.LEXICON)
    sinks.write_csv(df, str(tmp_path / "csv"))
    sinks.write_parquet(df, str(tmp_path / "l.parquet"))
    assert rows(tables.read_lexicon(spark, str(tmp_path / "csv"))) == rows(df)
    assert rows(tables.read_lexicon(spark, str(tmp_path / "l.parquet"))) == rows(df)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    for version in (1, 2, 10):
        sinks.write_version(spark.range(version), root, version)
    assert sinks.read_latest(spark, root).count() == 10
    with pytest.raises(Exception, match="exist"):
        sinks.write_version(spark.range(1), root, 2)


def test_partitioned_tables_are_pruned(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(20).withColumn("month", F.concat(F.lit("2023-"), F.col("id") % 4))
    sinks.write_parquet(df, path, partitioned_by=["month"])
    plan = spark.read.parquet(path).filter("month = '2023-1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_create_if_absent_keeps_rows(spark, tmp_path):
    name = "t_" + tmp_path.name.replace("-", "_")
    for _ in range(2):
        sinks.create_if_absent(spark, name, str(tmp_path / "a"), schemas.LEXICON)
        spark.createDataFrame([("w", 1.0)], schemas.LEXICON).write.insertInto(name)
    assert spark.table(name).count() == 2 and name in tables.user_tables(spark)
    assert tables.read_table(spark, name, ["word"]).columns == ["word"]
    assert name not in tables.user_tables(spark, system=[name])
    spark.sql(f"DROP TABLE {name}")


def test_bucketed_articles_do_not_move_in_joins_by_key(spark, tmp_path, monkeypatch):
    name = "b_" + tmp_path.name.replace("-", "_")
    sinks.create_if_absent(spark, name, str(tmp_path / "b"), schemas.ARTICLES, bucketed_by="id", buckets=8)
    rows = [(i, f"/{i}", None, f"t{i % 7}", None, None, None, "b") for i in range(40)]
    spark.createDataFrame(rows, schemas.ARTICLES).write.insertInto(name)
    monkeypatch.setattr("newsloom.operators.joins.fits_broadcast", lambda *a, **b: False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = dedup.dedup_second_oldest(spark.table(name))
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert kept.count() == 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide_side = plan[plan.index("SortMergeJoin") : plan.index("Bucketed: true")]
    assert "Exchange" not in wide_side and "SelectedBucketsCount" in plan
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_keys_are_consecutive(spark, parts):
    df = spark.range(100).select(F.col("id").alias("old")).repartition(parts)
    keyed = number_rows(df, 7)
    assert sorted(r.id for r in keyed.collect()) == list(range(8, 108))
    ordered = number_rows(df, 7, order_by=["old"])
    assert [(r.old, r.id) for r in ordered.orderBy("old").collect()] == [(i, i + 8) for i in range(100)]
    assert next_key(keyed) == 107 and next_key(keyed.filter("id < 0")) == 0


def test_column_pruning_and_pushdown_reach_the_scan(spark, sf_dir):
    plan = tables.read_parquet(spark, f"{sf_dir}/documents.parquet", ["doc_id"]).filter("doc_id > 5")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint>" in text and "GreaterThan(doc_id,5)" in text


def test_prices_since(spark):
    df = spark.createDataFrame([(dt.date(1998, 12, 31), 1.0), (dt.date(1999, 1, 1), 2.0)], schemas.PRICES)
    assert tables.prices_since(df, dt.date(1999, 1, 1)).count() == 1


def test_local_list(spark):
    assert [r.url for r in tables.frontier_from_list(spark, ["/a", None]).collect()] == ["/a", None]


def test_spread(spark):
    assert tables.spread(spark.range(10, numPartitions=1), "id", 4).rdd.getNumPartitions() == 4


def test_shared_folder_is_the_configured_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = session.shared_dir(spark)
    assert named is None or named in folder
    back = session.written_table(spark.range(3))
    assert back.count() == 3 and folder.removeprefix("file:") in back.inputFiles()[0]
