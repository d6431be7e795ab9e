"""Removing duplicate articles by title and subtitle."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators import joins
from newsloom.operators.joins import join_checked, null_safe_join
from newsloom.session import written_table

KEYS = ("title", "subtitle")
SALTS = 32


def smallest_ids(df: DataFrame, keys: Sequence[str], id_col: str, count: int) -> DataFrame:
    """Keys and ids of the ``count`` oldest rows per group.

    Spark limits each group to ``count`` rows per task before the shuffle, so a group holding a
    third of all rows costs a few rows per task.
    """
    oldest = Window.partitionBy(*keys).orderBy(id_col)
    ranked = df.select(*keys, id_col).withColumn("_rank", F.row_number().over(oldest))
    return ranked.filter(F.col("_rank") <= count)


def surviving_ids(df: DataFrame, keys: Sequence[str] = KEYS, id_col: str = "id") -> DataFrame:
    """One id per group: the only one, or the second oldest of several."""
    two = smallest_ids(df, keys, id_col, 2)
    return two.groupBy(*keys).agg(F.max(id_col).alias(id_col)).select(id_col)


def duplicate_groups(df: DataFrame, keys: Sequence[str] = KEYS, id_col: str = "id") -> DataFrame:
    """Groups with several rows, their oldest id and their size."""
    return (
        df.groupBy(*keys)
        .agg(F.min(id_col).alias("oldest"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def keep_ids(df: DataFrame, kept: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is in ``kept``; a row without id is in no list and stays, as after a DELETE by id."""
    gone = df.select(id_col).join(kept, id_col, "left_anti").filter(F.col(id_col).isNotNull())
    return delete_ids(df, written_table(gone, "gone"), id_col)


def dedup_second_oldest(
    df: DataFrame, keys: Sequence[str] = KEYS, id_col: str = "id"
) -> DataFrame:
    """Single rows stay; of several rows with equal keys (null equals null) the second oldest stays.

    Keys and ids are shuffled once, at most two per group and task.
    """
    two = smallest_ids(df, keys, id_col, 2)
    return keep_one(df, two.groupBy(*keys).agg(F.max(id_col).alias("_stays"), F.count(F.lit(1)).alias("_rows")), keys, id_col)


def keep_one(df: DataFrame, groups: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Of groups with several rows the one whose id is in ``_stays`` stays, and rows without id do.

    Only such groups are written.  While they are few (measured) they are broadcast, and no row moves again; beyond that
    the leaving ids are found by a join of keys, salted as a group may hold any share of the rows, and removed by id.
    """
    several = written_table(groups.filter(F.col("_rows") > 1).select(*keys, "_stays"), "several")
    leaves = F.col("_several") & F.col(id_col).isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_stays"))
    marked = several.withColumn("_several", F.lit(True))
    if joins.fits_broadcast(several):
        joined = null_safe_join(df, F.broadcast(marked), keys, "left")
        return joined.filter(~F.coalesce(leaves, F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns])
    salted = df.select(*keys, id_col).withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
    copies = marked.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    gone = null_safe_join(salted, copies, [*keys, "_salt"], "inner").filter(leaves).select(id_col)
    return delete_ids(df, written_table(gone, "gone"), id_col)


def delete_oldest_duplicate(
    df: DataFrame, keys: Sequence[str] = KEYS, id_col: str = "id"
) -> DataFrame:
    """Remove the oldest row of every group that has several."""
    doomed = duplicate_groups(df, keys, id_col).select(F.col("oldest").alias(id_col))
    return delete_ids(df, written_table(doomed, "doomed"), id_col)


def delete_ids(df: DataFrame, doomed: DataFrame, id_col: str = "id") -> DataFrame:
    """Remove the rows listed in ``doomed``; rows without id stay.

    Few ids (measured in rows and bytes) are broadcast and the wide rows never move; otherwise both sides shuffle by id,
    which is unique and thus even.
    """
    return join_checked(df, doomed, id_col, "left_anti")


def keep_oldest(df: DataFrame, keys: Sequence[str] = KEYS, id_col: str = "id") -> DataFrame:
    """Keep only the oldest row of every group."""
    return keep_one(df, df.groupBy(*keys).agg(F.min(id_col).alias("_stays"), F.count(F.lit(1)).alias("_rows")), keys, id_col)


# ---- batch by batch


class Increment(NamedTuple):
    kept: DataFrame  # rows of the batch to store
    removed: DataFrame  # ids that leave what is stored
    state: DataFrame  # what the state gains


def group_state(df: DataFrame, keys: Sequence[str] = KEYS, id_col: str = "id") -> DataFrame:
    """The two oldest ids of every group: oldest, second (null for single rows).  Rows without id are in no group."""
    two = smallest_ids(df.filter(F.col(id_col).isNotNull()), keys, id_col, 2)
    return two.groupBy(*keys).agg(
        F.min(id_col).alias("oldest"), F.when(F.count(F.lit(1)) > 1, F.max(id_col)).alias("second")
    )


def dedup_increment(batch: DataFrame, state: DataFrame, keys: Sequence[str] = KEYS, id_col: str = "id") -> Increment:
    """``dedup_second_oldest`` for a batch on top of stored ones, of which only the state of the batch's own groups is read.

    ``state`` holds what earlier increments returned, a group possibly in several rows.  Ids must grow from batch to batch, as appended keys
    do; a batch for which they do not is refused, since its right result would need rows that have been removed.
    """
    own = written_table(group_state(batch, keys, id_col), "own")
    names = own.select(*keys)
    if joins.fits_broadcast(names):
        mine = null_safe_join(state, F.broadcast(names), keys, "left_semi")
    else:
        mine = null_safe_join(state, names, keys, "left_semi")
    ids = mine.select(*keys, F.explode(F.array("oldest", "second")).alias(id_col))
    known = group_state(ids, keys, id_col).withColumnsRenamed({"oldest": "_oldest", "second": "_second"})
    met = written_table(null_safe_join(own, known, keys, "left"), "met")
    if met.filter(F.col("oldest") <= F.coalesce("_second", "_oldest")).limit(1).count():
        raise ValueError("ids of a batch must be larger than those stored before")
    # the second of a group is its first row after a stored single one, else its own second; after two stored ones all leave
    stays = F.when(F.col("_second").isNull(), F.when(F.col("_oldest").isNull(), F.coalesce("second", "oldest")).otherwise(F.col("oldest")))
    several = met.filter(F.col("_oldest").isNotNull() | F.col("second").isNotNull())
    kept = keep_one(batch, several.select(*keys, stays.alias("_stays"), F.lit(2).alias("_rows")), keys, id_col)
    removed = met.filter(F.col("_oldest").isNotNull() & F.col("_second").isNull()).select(F.col("_oldest").alias(id_col))
    return Increment(kept, removed, met.filter(F.col("_second").isNull()).select(*keys, "oldest", "second"))
