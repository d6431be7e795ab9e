"""Bloom filters as tables: which rows of a large side can have a partner, told without moving them.

The filter is cut into blocks of eight words.  A key's hash names its block and one bit in each word, so a test is a join with one broadcast row
and eight bit operations, all on the JVM.  Tasks combine their words before the shuffle, and blocks are merged by block, never in the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.joins import fits_broadcast, shuffled_join
from newsloom.session import written_table

WORDS = 8
BITS_PER_KEY = 16  # of keys that are not in the filter about one in a thousand passes
_BLOCK = "_block"


def _bit(column: str, word: int) -> Column:
    hashed = F.xxhash64(F.lit(1), F.col(f"`{column}`"))
    return F.shiftrightunsigned(hashed, 6 * word).bitwiseAND(F.lit(63)).cast("int")


def _block(column: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(blocks).cast("long"))


def bloom_blocks(keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """How many blocks a measured number of keys needs."""
    return max(1, -(-keys * bits_per_key // (64 * WORDS)))


def bloom_filter(df: DataFrame, column: str, blocks: int) -> DataFrame:
    """One row per block that holds a key: its number and eight words.  Null is no key."""
    one = F.lit(1).cast("long")
    words = {f"_w{i}": F.call_function("shiftleft", one, _bit(column, i)) for i in range(WORDS)}
    keys = df.filter(F.col(f"`{column}`").isNotNull()).select(_block(column, blocks).alias(_BLOCK), *[w.alias(n) for n, w in words.items()])
    return keys.groupBy(_BLOCK).agg(*[F.bit_or(n).alias(n) for n in words])


def with_membership(df: DataFrame, column: str, filter_: DataFrame, blocks: int, out: str = "_maybe") -> DataFrame:
    """Add whether a row's key may be in the filter; false is certain.  The filter is broadcast: measure it first."""
    names = [f"_w{i}" for i in range(WORDS)]
    joined = df.withColumn(_BLOCK, _block(column, blocks)).join(F.broadcast(filter_), _BLOCK, "left")
    found = F.lit(True)
    for i, name in enumerate(names):
        found = found & (F.call_function("shiftrightunsigned", F.col(name), _bit(column, i)).bitwiseAND(F.lit(1)) == 1)
    return joined.withColumn(out, F.coalesce(found, F.lit(False))).drop(_BLOCK, *names)


def without_keys(df: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose key is not in ``known``, where that is too large to broadcast.

    Rows that the filter rules out stay where they are; only possible hits are shuffled into the exact anti join.  If even the filter is too large
    (measured), all rows are.
    """
    keys = known.select(column).dropna()
    blocks = bloom_blocks(keys.count())
    filter_ = written_table(bloom_filter(keys, column, blocks), "bloom")
    if not fits_broadcast(filter_):
        return shuffled_join(df, keys.distinct(), column, "left_anti", collapse=True)
    marked = with_membership(df, column, filter_, blocks)
    sure = marked.filter(~F.col("_maybe")).drop("_maybe")
    maybe = marked.filter("_maybe").drop("_maybe")
    return sure.unionByName(shuffled_join(maybe, keys.distinct(), column, "left_anti", collapse=True))
