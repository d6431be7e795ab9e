"""Tables and files out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import schemas
from newsloom.operators.joins import null_safe_join
from newsloom.operators.keys import next_key, number_rows
from newsloom.session import written_table


def create_if_absent(
    spark: SparkSession,
    name: str,
    location: str,
    schema: T.StructType = schemas.ARTICLES,
    partitioned_by: Sequence[str] = (),
    bucketed_by: str | None = None,
    buckets: int = 200,
) -> None:
    """An empty Parquet table in the catalog, unless it is there already.

    Bucketing articles by id, or pages by address, lets the joins on that key leave the wide side
    where it is.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    layout = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    if bucketed_by:
        layout += f" CLUSTERED BY ({bucketed_by}) INTO {buckets} BUCKETS"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{layout} LOCATION '{location}'"
    )


def append_articles(
    spark: SparkSession, table: str, new: DataFrame, order_by: Sequence[str] | None = None
) -> None:
    """Append rows with keys that continue after the largest one in the table."""
    stored = spark.table(table)
    keyed = number_rows(new, next_key(stored), order_by)
    keyed.select(*stored.columns).write.insertInto(table)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header; quotes inside values are doubled."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(
    df: DataFrame, path: str, mode: str = "error", partitioned_by: Sequence[str] = ()
) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partitioned_by) if partitioned_by else writer).parquet(path)


def write_version(df: DataFrame, root: str, version: int) -> None:
    """Store a changed table next to the one it was read from; nothing is overwritten."""
    df.write.mode("error").parquet(f"{root}/version={version}")


def stored_versions(spark: SparkSession, root: str, name: str = "version") -> list[int]:
    """Numbers of the versions below ``root``, from the folder names alone; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [entry.getPath().getName() for entry in store.listStatus(path)] if store.exists(path) else []
    return sorted(int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}="))


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest stored version with its own columns, even if it has no rows; no other is touched."""
    return spark.read.parquet(f"{root}/version={stored_versions(spark, root)[-1]}")


def partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def in_partitions(rows: DataFrame, partitions: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose partition is listed (or not, as ``left_anti``); null is a partition like others.

    ``partitions`` has a row per folder of a table, which the driver lists anyway, and so is broadcast.
    """
    return null_safe_join(rows, F.broadcast(partitions), partitions.columns, how)


def rewrite_partitions(spark: SparkSession, table: str, changes: DataFrame, partition: str | Sequence[str], change) -> None:
    """Apply ``change`` to the partitions named in ``changes``; the files of all others stay untouched.

    ``changes`` has the partition column (or columns) and whatever ``change(rows, changes)`` needs to give the new rows of those
    partitions.  The new rows are written beside the table first.  They tell three sets of partitions apart: *gaining* ones, to which rows
    move from elsewhere, get those appended to what they hold; *changed* ones are replaced; *emptied* ones, for which no
    row is left, are cleared and dropped.  The sets are taken in this order, so a run that breaks off has lost nothing: at worst
    a moved row stands in its old partition, too, until the run is repeated with that row's key.

    Rows without a partition value are a partition of their own, also as named in ``changes``.  Naming partitions that do not exist is no error.
    """
    stored, named = spark.table(table), [partition] if isinstance(partition, str) else list(partition)
    levels = partition_columns(spark, table)
    old = in_partitions(stored, changes.select(*named).distinct())
    before = written_table(old.select(*levels).distinct(), "touched")
    fresh = written_table(change(old, changes).select(*stored.columns), "partitions")
    after = written_table(fresh.select(*levels).distinct(), "landing")
    gaining = in_partitions(after, before, "left_anti")
    if gaining.limit(1).count():
        in_partitions(fresh, gaining).select(*stored.columns).write.insertInto(table)
    changed = in_partitions(after, before)
    if changed.limit(1).count():
        mode = "spark.sql.sources.partitionOverwriteMode"
        kept = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")
        try:
            in_partitions(fresh, changed).select(*stored.columns).write.insertInto(table, overwrite=True)
        finally:
            spark.conf.set(mode, kept)
    for row in in_partitions(before, after, "left_anti").collect():  # a row per folder
        drop_partition(spark, table, row.asDict())


def drop_partition(spark: SparkSession, table: str, values: dict) -> None:
    """Remove a partition's rows and its entry.  Dropping alone would leave the files of a table at a location of its own."""

    def literal(value) -> str:
        return "null" if value is None else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"

    spec = ", ".join(f"`{name}` = {literal(value)}" for name, value in values.items())
    nothing = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()})" for f in spark.table(table).schema if f.name not in values)
    spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION ({spec}) SELECT {nothing} WHERE false")
    spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({spec})")
