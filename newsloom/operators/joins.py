"""Joins whose small side is measured before it is broadcast, and exact row repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.session import written_table

BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
REPEAT_CHUNK = 100_000
SPREAD_ROWS = 1000


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure ``df`` in one distributed aggregate: few enough rows, and few enough bytes."""
    width = F.lit(16)
    for f in df.schema:
        value = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(value), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            # eight bytes an element, or what it takes as text
            fixed = isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.NumericType, T.BooleanType, T.DateType))
            size = 24 + 8 * F.greatest(F.size(value), F.lit(0)) if fixed else F.octet_length(F.to_json(F.struct(value)))
            width = width + F.coalesce(size, F.lit(0))
        else:
            width = width + 16
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def join_checked(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str],
    how: str = "inner",
    collapse: bool = False,
    bound: DataFrame | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Broadcast ``small`` if it was measured to fit, else shuffle both sides.

    ``bound`` is a frame that is cheap to measure and at least as large as ``small``, such as the
    stored table ``small`` was reduced from; without it ``small`` itself is measured.

    With ``collapse`` the shuffling form first folds identical rows of ``big`` into one row with
    a count (combined before the shuffle) and unfolds them after the join, so a key repeated in a
    third of all rows does not land in one task.
    """
    measured = small if bound is None else bound
    if fits_broadcast(measured) if max_bytes is None else fits_broadcast(measured, max_bytes=max_bytes):
        return big.join(F.broadcast(small), on, how)
    return shuffled_join(big, small, on, how, collapse)


def shuffled_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", collapse: bool = False) -> DataFrame:
    """Both sides are shuffled; ``collapse`` as in ``join_checked``."""
    if not collapse:
        return big.join(small, on, how)
    folded = big.groupBy(*big.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return repeat_rows(folded.join(small, on, how), "_copies")


def salted_join(
    big: DataFrame, small: DataFrame, on: str, salt_by: Column, how: str = "inner", salts: int = 32
) -> DataFrame:
    """Equi join that spreads each key over ``salts`` tasks.

    ``salt_by`` must vary within a hot key and be computed from the row itself, so a repeated task
    gives the same salt.  ``small`` is copied once per salt; ``how`` must keep left rows only
    (inner, left, left_semi, left_anti).  Adaptive execution still splits what stays uneven.
    """
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def spread_join(big: DataFrame, small: DataFrame, parts: DataFrame, on: str, salt_by: Column, how: str = "inner") -> DataFrame:
    """Equi join that spreads a key over as many tasks as it needs.

    ``parts`` has that number (``_parts``, int) for the keys that need several, each once; the others stay whole, so ``small`` is copied
    for frequent keys alone.  ``salt_by`` and ``how`` as in ``salted_join``.
    """
    few = written_table(parts, "parts")
    salt = F.pmod(F.xxhash64(salt_by), F.coalesce("_parts", F.lit(1))).cast("int")
    salted = join_checked(big, few, on, "left").withColumn("_salt", salt).drop("_parts")
    last = F.coalesce("_parts", F.lit(1)) - 1
    copies = join_checked(small, few, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).drop("_parts")
    return salted.join(copies, [on, "_salt"], how).drop("_salt")


def frequent(df: DataFrame, on: str, rows: int = SPREAD_ROWS) -> DataFrame:
    """The keys of more than ``rows`` rows, with the number of parts they take at that many rows each."""
    counted = df.groupBy(on).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts"))
    return counted.filter(F.col("_parts") > 1)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Equi join in which null equals null; the key columns are those of ``left``."""
    both = F.lit(True)
    for c in on:
        both = both & F.col(f"_left.`{c}`").eqNullSafe(F.col(f"_right.`{c}`"))
    joined = left.alias("_left").join(right.alias("_right"), both, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.select(*[F.col(f"_left.`{c}`") for c in left.columns], *[F.col(f"_right.`{c}`") for c in right.columns if c not in on])


def with_prices(df: DataFrame, prices: DataFrame, day: str = "pubdate", date: str = "date") -> DataFrame:
    """Rows on days with a price, next to it.  A day may hold any share of the rows: prices are broadcast once
    measured to be small, else each day is spread over salted tasks."""
    named = prices.withColumnRenamed(date, day)
    if fits_broadcast(named):
        return df.join(F.broadcast(named), day).select(*df.columns, *[c for c in named.columns if c != day])
    return salted_join(df, named, day, F.xxhash64(*df.columns)).select(*df.columns, *[c for c in named.columns if c != day])


def repeat_rows(df: DataFrame, times: str, chunk: int = REPEAT_CHUNK) -> DataFrame:
    """Each row ``times`` times, without the count column.

    A large count is cut into chunks that are spread over the cluster before they unfold, so no
    task holds more than its share of one hot row.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c != times]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = df.filter(F.col(times) > 0).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / chunk)))
    )
    sized = pieces.withColumn(
        "_size", F.least(F.lit(chunk), F.col(times) - F.col("_piece") * chunk).cast("int")
    )
    spread = sized.repartition(tasks, "_piece", *columns)
    return spread.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_size")))).select(*columns)


def null_safe_members(df: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is among the distinct ``values`` (null matches null).

    ``values`` is a top-k list, so its size is bound by k.  The inner join of distinct values
    keeps each row once and, unlike a semi join, stays above a shared aggregate.
    """
    names = values.select(F.col(column).alias("_member"))
    return df.join(F.broadcast(names), df[column].eqNullSafe(names["_member"])).drop("_member")
