"""Mixing sources to target weights by hash thresholds.

Every row has a hash of its id.  A source that needs less than a whole copy of itself takes the rows
below a threshold: sizes are summed by source and hash bucket, the running sum shows in which bucket the
budget ends, and only that bucket is split further, until single hash values stand in it.  Nothing is
sorted, each round reads a narrow table, and a larger budget takes a superset of the rows.

Sources stand in order of code points, null last, and carry the given weights in turn.  A null text has
size 0; rows with equal ids share one hash and stay or go together; sizes count repeated rows singly.  A
source without words has target 0.  An empty table gives an empty mix.  Texts of any length are counted whole; columns named as
the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import word_count
from newsloom.operators.joins import fits_broadcast, join_checked, salted_join
from newsloom.operators.keys import number_rows
from newsloom.session import written_table

HASH_BITS = 60
BUCKET_BITS = 10  # buckets of a source in each round


def source_targets(sizes: DataFrame, share: float, weights: Sequence[float], cap: float) -> DataFrame:
    """Per source key: size, target and the whole copies in it; what capped sources leave is reshared."""
    totals = sizes.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("size").alias("source_size"))
    listed = number_rows(
        totals.withColumn("_last", F.col("_source").isNull()), order_by=["_last", "_source"], out="_no"
    )
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    listed = written_table(
        listed.withColumn("_weight", turn).withColumn("_cap", F.col("source_size") * F.lit(float(cap))), "sources"
    )
    budget, rate = None, 0.0
    while True:  # ends after at most as many rounds as there are sources; the driver holds three sums
        held = F.col("_cap") < F.col("_weight") * F.lit(rate)
        size, taken, free = listed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(held, F.col("_cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(held, 0.0).otherwise(F.col("_weight"))), F.lit(0.0)),
        ).first()
        budget = share * size if budget is None else budget
        higher = (budget - taken) / free if free else float("inf")
        if higher <= rate or higher == float("inf"):
            break
        rate = higher
    target = F.least(F.col("_cap"), F.col("_weight") * F.lit(rate)) if free else F.col("_cap")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    return listed.withColumn("target", target).select("_key", "source_size", "target", whole.alias("_whole"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source key the hash below which rows are taken once more than in the whole copies."""
    state = targets.select(
        "_key", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("_need"), F.lit(0).cast("long").alias("_low")
    ).filter(F.col("_need") > 0)
    ended, width = None, HASH_BITS
    while width > 0:
        at, width = width, width - BUCKET_BITS
        inside = join_checked(sizes, state, "_key").filter(F.shiftright(F.col("_hash") - F.col("_low"), at) == 0)
        counted = inside.groupBy("_key", "_need", "_low", F.shiftright(F.col("_hash") - F.col("_low"), width).alias("_bucket")).agg(
            F.sum("size").alias("_size"), F.countDistinct("_hash").alias("_values") if width == 0 else F.count(F.lit(1)).alias("_values")
        )
        order = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        edge = (
            counted.withColumn("_before", F.coalesce(F.sum("_size").over(order), F.lit(0)))
            .filter((F.col("_before") <= F.col("_need")) & (F.col("_need") < F.col("_before") + F.col("_size")))
            .select(
                "_key", (F.col("_need") - F.col("_before")).alias("_need"),
                (F.col("_low") + F.shiftleft(F.col("_bucket"), width)).alias("_low"), "_size", "_values",
            )
        )
        ended = written_table(edge, "thresholds")
        state = ended.select("_key", "_need", "_low")
        if not ended.filter(F.col("_values") > 1).limit(1).count():
            break
    # the value the budget ends in comes along if that is nearer to the target
    nearer = F.when(F.col("_need") * 2 >= F.col("_size"), F.lit(1 << width)).otherwise(F.lit(0))
    return ended.select("_key", (F.col("_low") + nearer).cast("long").alias("_below"))


def hashed(id_: F.Column) -> F.Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), id_.cast("string")), 64 - HASH_BITS)


def source_key(source: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))


def planned(df: DataFrame, id_: F.Column, text: str, source: str, share: float, weights: Sequence[float], cap: float) -> tuple[DataFrame, DataFrame]:
    """(_id, _key, _source, size, _hash) of every row, and per source its target, whole copies and the hash below which one more is taken."""
    sizes = written_table(
        df.select(
            id_.alias("_id"), source_key(source).alias("_key"), F.col(f"`{source}`").cast("string").alias("_source"),
            word_count(f"`{text}`").alias("size"), hashed(id_).alias("_hash"),
        ),
        "sizes",
    )
    targets = written_table(source_targets(sizes, share, weights, cap), "targets")
    limits = thresholds(sizes.select("_key", "size", "_hash"), targets)
    return sizes, written_table(targets.join(limits, "_key", "left"), "limits")


def with_copies(rows: DataFrame, limits: DataFrame, salt: F.Column) -> DataFrame:
    """Add what the row's source says, and how often the row is taken.  A source may hold any share of the rows: sources are broadcast once
    measured to be few, else each is spread over salted tasks."""
    if fits_broadcast(limits):
        mixed = rows.join(F.broadcast(limits), "_key")
    else:
        mixed = salted_join(rows, limits, "_key", salt)
    more = F.coalesce((F.col("_hash") < F.col("_below")).cast("long"), F.lit(0))
    return mixed.withColumn("copies", F.col("_whole") + more)


def mix(
    df: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), cap: float = 2.0,
    id_col: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """Per row: id, size, source_size, target, copies, taken (words the mix takes, repeats counted)."""
    sizes, limits = planned(df, F.col(f"`{id_col}`"), text, source, share, weights, cap)
    return with_copies(sizes, limits, F.col("_hash")).select(
        F.col("_id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def copies(
    df: DataFrame, share: float = 1.5, weights: Sequence[float] = (3, 1, 2), cap: float = 2.0,
    id_col: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The mixed corpus itself: the rows of ``df``, each as often as the mix takes it.

    Rows with one id and source share a hash.  A row's own hash and one small row per source decide, so no text moves.
    """
    pair = F.struct(F.col(f"`{id_col}`").alias("i"), F.col(f"`{source}`").alias("s"))
    _, limits = planned(df, pair, text, source, share, weights, cap)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    rows = df.select(whole, source_key(source).alias("_key"), hashed(pair).alias("_hash"))
    taken = with_copies(rows, limits, F.col("_hash")).filter("copies > 0")
    return taken.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")
