"""Quantile thresholds and the positive / negative / neutral label."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.session import written_table

# Labels, and the lower and upper quantile.
POSITIVE, NEGATIVE, NEUTRAL = "positiv", "negativ", "neutral"
QUANTILES = (0.05, 0.95)

# Thresholds keep nine decimals: values have six, so only float noise is removed.
_DECIMALS = 9


def group_quantiles(
    groups: DataFrame, value: str, weight: str | None = None, probs: Sequence[float] = QUANTILES
) -> DataFrame:
    """One row ``low, high, q``: exact, linearly interpolated quantiles of a reduced frame.

    ``q`` has one value for each of ``probs``, ``low`` and ``high`` are its first and last.  All values meet in
    one task, so this is for frames cut to a top-k list (days x k rows); others take ``exact_quantiles``.
    ``weight`` repeats a row that many times.
    """
    frequency = [F.col(weight)] if weight else []
    found = groups.agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]), *frequency).alias("q"))
    return with_ends(found.select(F.transform("q", lambda x: F.round(x, _DECIMALS)).alias("q")))


def with_ends(quantiles: DataFrame) -> DataFrame:
    return quantiles.select(F.get("q", F.lit(0)).alias("low"), F.element_at("q", -1).alias("high"), "q")


# Buckets of a pass: parts of each power of two in the first one, even parts of a bucket in those that follow.
_FIRST_PARTS, _PARTS = 64, 4096


def _first_bucket(v: Column) -> Column:
    """A number that never falls as ``v`` grows: by sign and power of two, then by parts of it; NaN is the largest value."""
    size = F.abs(v)
    power = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), power.cast("double")) - 1) * _FIRST_PARTS)
    place = (power + 2000) * _FIRST_PARTS + F.greatest(F.lit(0), F.least(F.lit(_FIRST_PARTS - 1), part))
    ends = F.when(F.isnan(v), 10**6).when(v == float("inf"), 10**6 - 1).when(v == float("-inf"), 1 - 10**6)
    return ends.when(v == 0, 0).otherwise(F.signum(v).cast("long") * place).cast("long")


def _holders(buckets: list, start: int, ranks: Sequence[int]) -> list[tuple]:
    """(least value, largest value, rows before, rows) of the buckets, in order, that hold the wanted ranks."""
    out, before = [], start
    for row in sorted(buckets, key=lambda r: r["bucket"]):
        if any(before <= r < before + row["n"] for r in ranks):
            out.append((row["low"], row["high"], before, row["n"]))
        before += row["n"]
    return out


def values_at(df: DataFrame, value: str, weight: str | None, wanted) -> tuple[int, dict[int, float]]:
    """Number of values, and the values at the ranks that ``wanted`` gives for that number, by radix selection.

    A first pass counts values by power of two and parts of it.  Rows of the buckets that hold wanted ranks are written, and each further pass
    counts such a bucket in even parts, until its least and largest value are one: at most five passes, since all values of a bucket have one exponent.
    The driver sees counts of buckets only, whose number the constants bound.
    """
    v = F.col(f"`{value}`").cast("double")
    n = F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")
    rows = df.select(v.alias("v"), n.alias("n")).filter("v is not null and n > 0")
    counted = [F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]
    first = rows.groupBy(_first_bucket(F.col("v")).alias("bucket")).agg(*counted).collect()
    total, found = sum(r["n"] for r in first), {}
    if total == 0:
        return 0, found
    ranks = sorted(set(wanted(total)))
    held = _holders(first, 0, ranks)
    stored = None
    while True:
        # values that floats cannot part (one value, the two zeros, NaN) are what stands at all ranks of their bucket
        found |= {r: low for low, high, before, size in held if not low < high for r in ranks if before <= r < before + size}
        held = [h for h in held if h[0] < h[1]]
        if not held:
            return total, found
        within = [F.col("v").between(low, high) for low, high, _, _ in held]
        inside = functools.reduce(operator.or_, within)
        stored = written_table(rows.filter(inside), "values") if stored is None else stored.filter(inside)
        of, part = F.lit(None).cast("int"), F.lit(None).cast("long")
        for k, (low, high, _, _) in enumerate(held):
            even = F.floor((F.col("v") - low) / F.lit(high - low) * _PARTS)
            of, part = F.when(within[k], k).otherwise(of), F.when(within[k], F.least(F.lit(_PARTS - 1), even)).otherwise(part)
        parts = stored.groupBy(of.alias("of"), part.alias("bucket")).agg(*counted).collect()
        held = [h for k, (_, _, before, _) in enumerate(held) for h in _holders([r for r in parts if r["of"] == k], before, ranks)]


def exact_quantiles(
    df: DataFrame, value: str, weight: str | None = None, probs: Sequence[float] = QUANTILES
) -> DataFrame:
    """As ``group_quantiles`` for frames of any size (one row per article, or per day and free-text label): nothing is sorted, and no
    task or driver holds more than counts of buckets."""

    def wanted(total: int) -> list[int]:
        return [f(at) for p in probs for at in ((total - 1) * float(p),) for f in (math.floor, math.ceil)]

    total, at_rank = values_at(df, value, weight, wanted)

    def between(p: float) -> Column:
        if total == 0:
            return F.lit(None).cast("double")
        at = (total - 1) * float(p)
        low, high = at_rank[math.floor(at)], at_rank[math.ceil(at)]
        return F.round(F.lit(low if low == high else low + (high - low) * (at - math.floor(at))), _DECIMALS)

    return with_ends(df.sparkSession.range(1).select(F.array(*[between(p) for p in probs]).alias("q")))


def bounded_thresholds(quantiles: DataFrame, floor: float) -> DataFrame:
    """Thresholds at least ``floor`` away from zero on either side."""
    return quantiles.select(
        F.least(F.col("low"), F.lit(0.0 - floor)).alias("low"),
        F.greatest(F.col("high"), F.lit(float(floor))).alias("high"),
    )


def classify_extremes(
    df: DataFrame,
    value: str,
    floor: float,
    quantiles: DataFrame | None = None,
    weight: str | None = None,
    out: str = "sentiment",
) -> DataFrame:
    """Label values strictly beyond the bounded thresholds.

    The one-row thresholds enter as a scalar subquery, so no row is joined or moved for them.
    """
    limits = bounded_thresholds(
        quantiles if quantiles is not None else group_quantiles(df, value, weight), floor
    )
    limit = limits.select(F.struct("low", "high")).scalar()
    return df.withColumn(
        out,
        F.when(F.col(value) > limit["high"], F.lit(POSITIVE))
        .when(F.col(value) < limit["low"], F.lit(NEGATIVE))
        .otherwise(F.lit(NEUTRAL)),
    )
