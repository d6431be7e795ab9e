"""The frontier as a log: addresses found and outcomes are appended run by run, and nothing is rewritten until it is compacted.

Below the root, ``entries/run=k`` has the rows found by run k and ``outcomes/run=k`` what came of the addresses it tried; a run is
written again under its number if it broke off.  The current frontier is what applying each run's outcomes to all rows so far would give:
an outcome concerns the rows found up to its run.  ``state/run=k`` is the frontier as of run k, and stands for all runs up to it.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom import schemas
from newsloom.operators.frontier import DONE, FAILED, TODO, as_frontier
from newsloom.operators.joins import join_checked
from newsloom.sources.sinks import stored_versions

OUTCOMES = "url string, failed boolean"


def append_run(spark: SparkSession, root: str, run: int, entries: DataFrame | None = None, outcomes: DataFrame | None = None) -> None:
    """Add what a run found and what became of the addresses it tried; run numbers grow."""
    compacted = stored_versions(spark, f"{root}/state", "run")
    if compacted and run <= compacted[-1]:
        raise ValueError(f"run {run} is part of the compacted state of run {compacted[-1]}")
    if entries is not None:
        as_frontier(entries).write.mode("overwrite").parquet(f"{root}/entries/run={run}")
    if outcomes is not None:
        per_url = outcomes.filter(F.col("url").isNotNull()).groupBy("url").agg(F.max("failed").alias("failed"))
        per_url.write.mode("overwrite").parquet(f"{root}/outcomes/run={run}")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The frontier after all runs: state or entries joined once with the outcomes of each address."""
    compacted = stored_versions(spark, f"{root}/state", "run")[-1:]
    entries = [_read(spark, root, "state", n, schemas.FRONTIER) for n in compacted]
    entries += [_read(spark, root, "entries", n, schemas.FRONTIER) for n in _later(spark, root, "entries", compacted)]
    outcomes = [_read(spark, root, "outcomes", n, OUTCOMES) for n in _later(spark, root, "outcomes", compacted)]
    if not entries:
        return spark.createDataFrame([], schemas.FRONTIER)
    rows = functools.reduce(DataFrame.unionByName, entries)
    if not outcomes:
        return rows.drop("_run")
    per_url = functools.reduce(DataFrame.unionByName, outcomes).groupBy("url").agg(
        F.sort_array(F.collect_list(F.struct("_run", "failed"))).alias("_outcomes")  # one for each run that tried the address
    )
    joined = join_checked(rows, per_url, "url", "left", collapse=True)
    of_row = F.filter(F.coalesce("_outcomes", F.array()), lambda o: o["_run"] >= F.col("_run"))
    known = joined.withColumn("_outcomes", of_row)
    first = F.get("_outcomes", F.lit(0))["failed"]
    tried = (F.col("downloaded") == TODO) & first.isNotNull()
    return known.select(
        F.when(~F.exists("_outcomes", lambda o: o["failed"]), F.col("url")).alias("url"),
        "datum",
        F.when(tried & first, F.lit(FAILED)).when(tried, F.lit(DONE)).otherwise(F.col("downloaded")).cast("int").alias("downloaded"),
    )


def compact(spark: SparkSession, root: str, run: int) -> None:
    """Store the frontier as of ``run``, the last one appended; older folders are not read again and may be removed."""
    current(spark, root).write.parquet(f"{root}/state/run={run}")


def _later(spark: SparkSession, root: str, part: str, compacted: list[int]) -> list[int]:
    return [n for n in stored_versions(spark, f"{root}/{part}", "run") if not compacted or n > compacted[0]]


def _read(spark: SparkSession, root: str, part: str, run: int, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{root}/{part}/run={run}").withColumn("_run", F.lit(run))
