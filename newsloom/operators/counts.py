"""Counts, sums, top-k lists, lumping and shares."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.joins import fits_broadcast, null_safe_members, salted_join

# Fixed value: the catch-all label.
OTHER = "sonstiges"


def count_by(df: DataFrame, *keys: str | Column, out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def sum_by(df: DataFrame, value: str, *keys: str | Column, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.sum(value), 6).alias(out))


def top_k(df: DataFrame, label: str, k: int, weight: str | None = None) -> DataFrame:
    """The k most frequent labels with their counts; equal counts go by label, null last.

    ``weight`` sums existing counts, so the list can come from an already reduced frame.
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(label).agg(amount.alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last(label)).limit(k)


def exclude(df: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """Drop rows whose value is listed; null is never listed."""
    return df.filter(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def named_only(top: DataFrame, label: str, blank: bool = True) -> DataFrame:
    """A top-k list without null, the catch-all label and, if wanted, the blank one.

    Filtering the short list instead of the counted rows leaves those rows shareable.
    """
    named = top.filter(F.col(label) != OTHER)
    return named if blank else named.filter(F.col(label) != "")


def keep_top(df: DataFrame, top: DataFrame, label: str) -> DataFrame:
    """Rows whose label is in the top-k list."""
    return null_safe_members(df, top, label)


def lump(df: DataFrame, top: DataFrame, label: str, out: str, other: str = OTHER) -> DataFrame:
    """Labels outside the top-k list become ``other``."""
    members = top.select(F.col(label).alias("_member"), F.lit(True).alias("_in"))
    marked = df.join(F.broadcast(members), df[label].eqNullSafe(members["_member"]), "left")
    return marked.withColumn(
        out, F.when(F.col("_in"), F.col(label)).otherwise(F.lit(other))
    ).drop("_member", "_in")


def share_within(df: DataFrame, amount: str, parent: str, out: str = "percentage", calendar: bool = False) -> DataFrame:
    """``amount`` as a share of its parent group, for reduced frames.

    The totals are combined before they move.  If they are measured to be small they are broadcast, else a parent's rows
    are spread over salted tasks, so a parent with very many rows is not gathered in one.  Parents from the ``calendar`` (days or weeks) are
    few by nature, so their totals need no measuring job.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(parent).cast("string")), F.lit(""))  # null is a group too
    keyed = df.withColumn("_parent", key)
    totals = keyed.groupBy("_parent").agg(F.sum(amount).alias("_total"))
    if calendar or fits_broadcast(totals):
        joined = keyed.join(F.broadcast(totals), "_parent")
    else:
        joined = salted_join(keyed, totals, "_parent", F.xxhash64(*df.columns))
    return joined.withColumn(out, F.col(amount) / F.col("_total")).select(*df.columns, out)
