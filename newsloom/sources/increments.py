"""A table that grows by batches and stays free of duplicates, without being rewritten.

Three folders, each with one folder per batch: ``rows`` as stored, ``removed`` ids that later batches made leave, and ``state`` with the two oldest ids of
every group.  A batch that broke off is written again under its number; ``rows`` comes last and tells which batches are complete.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from newsloom.operators import dedup
from newsloom.sources.sinks import stored_versions


def complete_batches(spark: SparkSession, root: str) -> list[int]:
    return stored_versions(spark, f"{root}/rows", "batch")


def _stored(spark: SparkSession, root: str, part: str, batches: Sequence[int]) -> DataFrame:
    tables = [spark.read.parquet(f"{root}/{part}/batch={n}") for n in batches]
    return functools.reduce(DataFrame.unionByName, tables)


def append_batch(
    spark: SparkSession, root: str, batch: DataFrame, number: int, keys: Sequence[str] = dedup.KEYS, id_col: str = "id"
) -> None:
    """Add a batch whose ids are larger than all stored ones.  A number that is complete is an error."""
    done = complete_batches(spark, root)
    if number in done or done and number < done[-1]:
        raise ValueError(f"batch {number} comes after {done[-1]}")
    state = _stored(spark, root, "state", done) if done else dedup.group_state(batch.limit(0), keys, id_col)
    new = dedup.dedup_increment(batch, state, keys, id_col)
    for part, rows in (("state", new.state), ("removed", new.removed)):
        rows.write.mode("overwrite").parquet(f"{root}/{part}/batch={number}")
    new.kept.write.parquet(f"{root}/rows/batch={number}")


def read_batches(spark: SparkSession, root: str, id_col: str = "id") -> DataFrame:
    """All rows that are still there: few removed ids (measured) are broadcast."""
    done = complete_batches(spark, root)
    return dedup.delete_ids(_stored(spark, root, "rows", done), _stored(spark, root, "removed", done), id_col)
