"""Surrogate keys for appended rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import written_table

_SLICE_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def number_rows(
    df: DataFrame, start: int = 0, order_by: Sequence[str] | None = None, out: str = "id"
) -> DataFrame:
    """Consecutive keys after ``start``, in row order or in the given order.

    The batch is written once with each row's slice and place in it; a key is then the rows in
    earlier slices plus that place.  Nothing passes through a single task but one count per slice.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = written_table(df.withColumn("_at", F.monotonically_increasing_id()), "batch")
    placed = placed.withColumn("_slice", F.shiftright("_at", _SLICE_BITS)).withColumn(
        "_place", F.col("_at") - F.shiftleft("_slice", _SLICE_BITS)
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size")).select(
        "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before")
    )
    return (
        placed.join(F.broadcast(starts), "_slice")
        .withColumn(out, (F.col("_before") + F.col("_place") + F.lit(start + 1)).cast("long"))
        .drop("_at", "_slice", "_place", "_before")
    )


def next_key(df: DataFrame, key: str = "id") -> int:
    """The largest key in use, 0 for an empty table."""
    return df.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
