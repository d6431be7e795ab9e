"""Stored tables and files in; every reader takes or has an explicit schema."""

from __future__ import annotations

import csv
import datetime as dt
import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import schemas
from newsloom.operators.joins import join_checked
from newsloom.session import written_table

# Fixed value: bookkeeping tables a catalog listing leaves out.
SYSTEM_TABLES = ("sqlite_sequence",)


def user_tables(spark: SparkSession, system: Sequence[str] = SYSTEM_TABLES) -> list[str]:
    """Names of the catalog's tables and views without bookkeeping tables."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name not in system)


def read_table(spark: SparkSession, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A whole table, or only some columns of it; Spark reads no others."""
    table = spark.table(name)
    return table.select(*columns) if columns else table


def read_parquet(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    table = reader.parquet(path)
    return table.select(*columns) if columns else table


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` by name and type; absent ones and unreadable values become null."""
    return df.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema
        ]
    )


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
    header: Sequence[str] | None = None,
) -> DataFrame:
    """CSV with a header, read by column name: other columns (an index, say) are left out.

    Files of a folder, at any depth, may have different headers; each is read by its own.  Tasks find the headers in a pass over the lines
    that parses nothing; it is saved if the caller knows the ``header`` of all files.  All files are then read in one scan by position,
    next to the positions of the wanted columns in their file.  Compressed files are read like others.

    ``multi_line`` allows line breaks inside values, and inside headers; such files cannot be split into tasks.
    """
    if header is None:
        firsts = written_table(first_records(spark, path, multi_line), "headers")
        layouts = {r["first"]: _names(r["first"], multi_line) for r in firsts.select("first").distinct().collect()}  # a row per layout
    else:
        firsts, layouts = None, {"": list(header)}
    positions = {first: [names.index(f.name) if f.name in names else -1 for f in schema] for first, names in layouts.items()}
    width = max((len(names) for names in layouts.values()), default=1)
    by_place = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(max(1, width))])
    raw = _csv_reader(spark, multi_line).option("header", True).schema(by_place).csv(path)
    if firsts is None:
        rows, place = raw, [F.lit(p) for p in positions[""]]
    else:
        known = spark.createDataFrame(list(positions.items()), "first string, _places array<int>")
        places = firsts.join(F.broadcast(known), "first").select(F.col("file").alias("_file"), "_places")
        rows = join_checked(raw.select("*", F.col("_metadata.file_path").alias("_file")), places, "_file", bound=firsts)
        place = [F.col("_places")[k] for k in range(len(schema))]

    def value(k: int) -> F.Column:
        found = F.lit(None).cast("string")
        for at in sorted({p[k] for p in positions.values()} - {-1}):
            found = F.when(place[k] == at, F.col(f"_c{at}")).otherwise(found)
        return found

    table = conform(rows.select(*[value(k).alias(f.name) for k, f in enumerate(schema)]), schema)
    return table.select(*columns) if columns else table


WIDEST = 512  # columns of a header that spans lines; others may have any number


def _csv_reader(spark: SparkSession, multi_line: bool):
    return spark.read.option("escape", '"').option("multiLine", multi_line).option("recursiveFileLookup", True)


def first_records(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(file, first): the first record that is not blank of each file, as its line or, with ``multi_line``, as its values in JSON.

    A file begins in one task, which sees its lines in order, so the first one a task meets is kept and nothing but one row per file moves.
    """
    if multi_line:
        wide = T.StructType([T.StructField(f"_c{k}", T.StringType()) for k in range(WIDEST)])
        raw = _csv_reader(spark, True).schema(wide).csv(path)
        first = F.to_json(F.array(*wide.names))
    else:
        raw, first = spark.read.option("recursiveFileLookup", True).text(path), F.col("value")
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), first.alias("first"))
    begins = lines.filter((F.col("at") == 0) & (F.trim("first") != ""))
    return begins.groupBy("file").agg(F.first("first").alias("first"))


def _names(first: str, multi_line: bool) -> list[str | None]:
    names = json.loads(first) if multi_line else next(csv.reader([first]))
    while names and names[-1] is None:
        names.pop()
    return [n.removeprefix("\ufeff") if k == 0 and n else n for k, n in enumerate(names)]


def files_below(spark: SparkSession, path: str) -> list:
    """Paths of the data files of a file or folder (any depth), in order; hidden ones are left out."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    walk, found = store.listFiles(root, True), []
    while walk.hasNext():
        file = walk.next().getPath()
        parts = file.toUri().getPath().removeprefix(root.toUri().getPath()).split("/")
        if not any(p.startswith(("_", ".")) for p in parts if p):
            found.append(file)
    return sorted(found, key=lambda f: f.toString())


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Words and their values from CSV or Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return read_parquet(spark, path, ["word", "value"])
    return read_csv(spark, path, schemas.LEXICON)


def prices_since(prices: DataFrame, start: dt.date) -> DataFrame:
    """Daily prices from a start date; the filter reaches the scan."""
    return prices.filter(F.col("date") >= F.lit(start))


def frontier_from_list(spark: SparkSession, urls: Iterable[str | None]) -> DataFrame:
    """A frame of addresses from a local list."""
    return spark.createDataFrame([(u,) for u in urls], T.StructType([schemas.FRONTIER["url"]]))


def spread(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """Rows dealt over ``tasks`` by a unique key, for the caller who knows that the stored files give too few tasks.

    The whole rows move, so tables are better written in files or row groups of a task's size.
    """
    # always true, but it keeps costly filters above the exchange, where they run in all tasks
    return df.repartition(tasks, key).filter(F.spark_partition_id() >= 0)
