"""Exact top-k inner products by norm buckets.

Vectors are scaled to integers.  A task takes a block of queries and a block of all vectors, sorts the
vectors into buckets by length, longest first, and keeps each query's k-th best product so far.  That
product over the lengths of query and bucket is a local cosine threshold: above 1 nothing in this or any
later bucket can enter; a high one is tested on the query's strongest coordinates, of which only a range
can reach the threshold; a low one only on length.  What is left is multiplied out exactly.  Tasks send k rows
a query, of which the best stay.

Vectors that are null, empty or hold null or non-finite components take no part, nor do queries without id;
integers beyond 64 bits saturate.  Vectors of different dimension are not compared.  A query is compared with all rows
but those with its id; repeated rows count singly, queries with equal id and vector once; those that share an id but not the vector have one common ranking.
Ties go to the smaller id, null last.  An empty table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import ready_for_python
from newsloom.session import written_table

QUERY_BLOCK = 1024
VECTOR_BLOCK = 16384
BUCKET = 1024  # vectors of neighbouring length that share bounds
STEEP = 0.5  # local cosine thresholds from which coordinates prune better than length
LARGE = 2.0**53
INT_LOW, INT_HIGH = -(2**63), 2**63 - 1


def products(block: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products: in floats if no sum can leave their exact range, else in Python's integers."""
    if block.size == 0:
        return np.zeros(len(block), np.int64)
    most = float(np.abs(block.astype(np.float64)).max()) * float(np.abs(query.astype(np.float64)).max()) * max(1, len(query))
    if most < LARGE:
        return (block.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    exact = block.astype(object) @ query.astype(object)
    return np.array([min(max(int(x), INT_LOW), INT_HIGH) for x in exact], np.int64)


class Buckets:
    """A block of vectors sorted by length, with each coordinate of each bucket in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.vectors, self.lengths = ids[order], vectors[order], lengths[order]
        safe = np.where(self.lengths > 0, self.lengths, 1.0)
        self.units = self.vectors / safe[:, None]
        self.floats = self.vectors.astype(np.float64)
        self.starts = range(0, len(order), BUCKET)
        self.sorted: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, start: int, axis: int) -> tuple[np.ndarray, np.ndarray]:
        if (start, axis) not in self.sorted:
            values = self.units[start : start + BUCKET, axis]
            order = np.argsort(values, kind="stable")
            self.sorted[start, axis] = values[order], order
        return self.sorted[start, axis]

    def near(self, start: int, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Places whose strongest coordinates allow the threshold: for unit vectors of cosine t or more, one
        coordinate of the other lies in u*t +- sqrt((1-u^2)(1-t^2))."""
        first, second = np.argsort(-np.abs(unit))[:2] if len(unit) > 1 else (0, 0)
        places = None
        for axis in (first, second):
            u = float(unit[axis])
            # from t = -1..1 on the range is an interval; below u*t it only widens, so |u| bounds it
            reach = np.sqrt(max(0.0, 1 - u * u) * max(0.0, 1 - cosine * cosine)) + 1e-9
            low, high = u * cosine - reach, u * cosine + reach
            high, low = (1.0, low) if u >= cosine else (high, low)
            low = -1.0 if -u >= cosine else low
            if places is None:
                values, order = self.coordinate(start, axis)
                places = order[np.searchsorted(values, low, "left") : np.searchsorted(values, high, "right")] + start
            else:
                x = self.units[places, axis]
                places = places[(x >= low) & (x <= high)]
        return places

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the k best, smaller ids first among equals."""
        length = float(np.sqrt((query.astype(np.float64) ** 2).sum()))
        unit = query / length if length else query.astype(np.float64)
        ids, scores = np.zeros(0, object), np.zeros(0, np.int64)
        for start in self.starts:
            stop = min(start + BUCKET, len(self.ids))
            places = np.arange(start, stop)
            if len(scores) >= k and length:
                least, longest = float(scores[-1]), float(self.lengths[start])
                bound = least - abs(least) * 1e-9 - 1e-6
                cosine = bound / (length * longest) if longest else (1.1 if bound > 0 else -1.0)
                if cosine > 1:
                    break
                if cosine >= STEEP:
                    places = self.near(start, unit, cosine)
                if bound > 0:
                    places = places[self.lengths[places] * length >= bound]
            places = places[self.ids[places] != query_id]
            if len(places) == 0:
                continue
            ids = np.concatenate([ids, self.ids[places]])
            scores = np.concatenate([scores, products(self.vectors[places], query)])
            order = best_first(ids, scores)
            ids, scores = ids[order[:k]], scores[order[:k]]
        return ids, scores


def best_first(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Places by falling product, then rising id, null last."""
    missing = np.array([i is None for i in ids], bool)
    known = np.where(missing, 0, ids).astype(np.int64)
    # -1 - s rises as s falls, also at the ends of 64 bits
    return np.lexsort((known, missing, -1 - scores))


def prepare(df: DataFrame, id_col: str, vector: str, scale: float) -> DataFrame:
    """(_id, _v as integers, _dim) of the vectors that take part, on the JVM."""
    v = F.col("_raw")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        df.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{vector}`").cast("array<double>").alias("_raw"))
        .filter(v.isNotNull() & (F.size(v) > 0) & finite)
        .select("_id", F.transform("_raw", lambda x: F.floor(x * scale).cast("long")).alias("_v"), F.size("_raw").alias("_dim"))
    )


def search(
    df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", scale: float = 1024.0
) -> DataFrame:
    """Per query: query_id, rank, vec_id, score of its ``k`` best rows of ``df``."""
    ready_for_python(df)
    rows = written_table(prepare(df, id_col, vector, scale), "vectors")
    asked = written_table(
        prepare(queries, id_col, vector, scale).filter(F.col("_id").isNotNull()).dropDuplicates(["_id", "_v"]), "queries"
    )
    blocks = max(1, -(-rows.count() // VECTOR_BLOCK))
    sets = max(1, -(-asked.count() // QUERY_BLOCK))
    # every block of vectors meets every block of queries once
    left = rows.withColumn("_b", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(blocks))).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))
    )
    right = asked.withColumn("_s", F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(sets)).cast("int")).withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )

    def run(vectors: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(wanted):
            block = Buckets(np.array([None if pd.isna(i) else int(i) for i in vectors["_id"]], object), np.stack(vectors["_v"].to_list()))
            for query_id, query in zip(wanted["_id"], wanted["_v"], strict=True):
                ids, scores = block.best(int(query_id), np.asarray(query), k)
                out += [(int(query_id), i, int(s)) for i, s in zip(ids, scores, strict=True)]
        frame = pd.DataFrame(out, columns=["query_id", "vec_id", "score"])
        return frame.astype({"query_id": "int64", "vec_id": "Int64", "score": "int64"})

    found = (
        left.groupBy("_b", "_s", "_dim")
        .cogroup(right.groupBy("_b", "_s", "_dim"))
        .applyInPandas(run, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
