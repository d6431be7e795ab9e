"""Short codes for vectors: product codebooks, searched by a GNAT over the entries.

Components become integers floor(1024 * x), vectors are cut into equal parts, and every part position has a codebook
that a fixed number of rounds improves: each part goes to its nearest entry, each entry becomes the floored mean of its parts.
Everything is integer arithmetic, so results do not depend on how rows are dealt over tasks.

The nearest entry is found in a GNAT (geometric near-neighbour access tree).  A node has split points far apart; every other
entry below it belongs to the split point nearest to it, and the node stores, for each pair of a split point and a child, the
least and largest distance from the one to the entries of the other.  The distance of a query to a split point and that range
bound the query's distance to all entries of a child, and the child is left out only if the bound lies strictly above the
best distance so far.  Bounds are widened by more than floats can be off, so an entry as near as the best is always visited; distances that
decide are integers, and of equal ones the lower index wins.

Tasks send one sum per part and entry; the driver holds the codebooks, whose size the parameters fix.

Vectors take part if they have the length of the vector with the smallest id, that length can be cut into the parts, and no component is null
or not finite.  Components beyond the range in which squared distances fit 64 bits (2^27 for 64 components) are set to its ends.
Rows without id are coded like all others, but start no codebook while there are rows with one; rows that share an id are ordered by
their vectors, and all count.  With fewer rows than entries the codebooks are as short as the rows are few.  An empty table gives an empty result.
Other columns of the table play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import ready_for_python
from newsloom.operators.joins import fits_broadcast, salted_join
from newsloom.session import written_table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
ARITY = 16  # split points of a node
LEAF = 16  # as many entries are compared one by one
SAFE = 1e-12  # far above the error of a square root and a difference of doubles
EXACT = 2.0**52


def limit(width: int) -> int:
    """The largest component with which squared distances of that many components fit 64 bits."""
    return math.isqrt(2**62 // max(1, width)) // 2


def scaled(values: np.ndarray) -> np.ndarray:
    """Integers floor(1024 * x) of rows of doubles."""
    most = limit(values.shape[1])
    with np.errstate(over="ignore"):  # beyond the range of doubles is beyond the range kept
        return np.clip(np.floor(values * SCALE), -most, most).astype(np.int64)


def in_floats(*rows: np.ndarray) -> bool:
    """Whether squared distances of these rows, and all terms of them, are exact in doubles."""
    most = max((max(abs(int(r.max())), abs(int(r.min()))) for r in rows if r.size), default=0)
    return 4.0 * most * most * rows[0].shape[1] < EXACT


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of both."""
    crossed = left @ right.T
    return (left * left).sum(1)[:, None] + (right * right).sum(1)[None, :] - 2 * crossed


class Gnat:
    """Nearest entries by exclusion of subtrees; ``compared`` counts the distances that were computed."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.compared = 0
        self.root = self._node(np.arange(len(entries)))

    def _node(self, members: np.ndarray):
        if len(members) <= LEAF:
            return members, None, None, None
        chosen = [0]
        points = self.entries[members]
        away = squared(points, points[:1])[:, 0]
        while len(chosen) < ARITY:
            away[chosen[-1]] = -1  # a chosen one is never chosen again, equal entries may be
            chosen.append(int(away.argmax()))
            away = np.minimum(away, squared(points, points[chosen[-1:]])[:, 0])
        chosen.sort()
        rest = np.setdiff1d(np.arange(len(members)), chosen)
        far = squared(points[rest], points[chosen])
        owner = far.argmin(1)
        lengths = np.sqrt(far.astype(np.float64))
        low, high = np.full((ARITY, ARITY), np.inf), np.full((ARITY, ARITY), -np.inf)
        children = []
        for j in range(ARITY):
            own = owner == j
            if own.any():
                low[:, j], high[:, j] = lengths[own].min(0) * (1 - SAFE), lengths[own].max(0) * (1 + SAFE)
            children.append(self._node(members[rest[own]]) if own.any() else None)
        return members[chosen], low, high, children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each query's nearest entry; of equal ones the lower index."""
        entries = self.entries
        if in_floats(queries, entries):
            queries, entries = queries.astype(np.float64), entries.astype(np.float64)
        # of |q|^2 - 2qe + |e|^2 the first term is added at the end: it is the same for all entries
        asked = queries, (queries * queries).sum(1), entries.T * -2, (entries * entries).sum(1)
        best = np.full(len(queries), np.iinfo(np.int64).max // 2, queries.dtype)
        index = np.full(len(queries), len(entries))
        if len(queries):
            self._visit(self.root, asked, np.arange(len(queries)), best, index)
        return index, (best + asked[1]).astype(np.int64)

    def _visit(self, node, asked, rows, best, index) -> None:
        members, low, high, children = node
        queries, own, crossed, lengths = asked
        far = queries[rows] @ crossed[:, members]
        far += lengths[members]
        self.compared += far.size
        place = far.argmin(1)  # members ascend, so the first of equal ones has the lowest index
        least, found = far[np.arange(len(rows)), place], members[place]
        before = best[rows]
        better = (least < before) | (least == before) & (found < index[rows])
        best[rows[better]], index[rows[better]] = least[better], found[better]
        if children is None:
            return
        away = np.sqrt((far + own[rows, None]).astype(np.float64))
        bound = np.zeros((len(rows), ARITY))  # what every entry of a child is away at least
        for i in range(ARITY):
            np.maximum(bound, (away[:, i] * (1 - SAFE))[:, None] - high[i], out=bound)
            np.maximum(bound, low[i] - (away[:, i] * (1 + SAFE))[:, None], out=bound)
        for first in (True, False):  # each query first enters the child of its nearest split point, which tightens its best
            reach = np.sqrt((best[rows] + own[rows]).astype(np.float64)) * (1 + SAFE)
            open_ = (bound <= reach[:, None]) & ((np.arange(ARITY) == place[:, None]) == first)
            for j, child in enumerate(children):
                at = np.flatnonzero(open_[:, j]) if child is not None else ()
                if len(at):
                    self._visit(child, asked, rows[at], best, index)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return scaled(flat.reshape(len(column), width))


def sums(kept: DataFrame, books: list[np.ndarray], width: int) -> list[tuple]:
    """(part, entry, count, sums of the components) of the parts that each entry is nearest to."""
    parts, step = len(books), width // len(books)
    trees = [Gnat(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, len(books[0])), np.int64)
        total = np.zeros((parts, len(books[0]), step), np.int64)
        for batch in batches:
            v = matrix(batch.column(0), width)
            for p, tree in enumerate(trees):
                own = v[:, p * step : (p + 1) * step]
                index, _ = tree.nearest(own)
                count[p] += np.bincount(index, minlength=count.shape[1])
                np.add.at(total[p], index, own)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "total"],
        )

    made = kept.select("_v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    added = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(step)]
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect()  # a row per part and entry


def compress(
    df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes (_id, _label, codes array<int>, error long), and the codebooks they point into."""
    v = F.col(f"`{vector}`").cast("array<double>")
    found = ready_for_python(df).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").alias("_label"), v.alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = found.filter((F.size("_v") > 0) & (F.size("_v") % parts == 0) & finite)
    first = [F.col("_id").asc_nulls_last(), "_v"]
    leading = found.select("_id", "_v").orderBy(*first).limit(1).collect()
    if not leading:
        return found.select("_id", "_label", F.lit(None).cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error")), []
    width = len(leading[0]["_v"])
    step = width // parts
    kept = found.filter(F.size("_v") == width)
    start = scaled(np.array([r["_v"] for r in kept.select("_id", "_v").orderBy(*first).limit(entries).collect()]))
    books = [start[:, p * step : (p + 1) * step].copy() for p in range(parts)]
    for _ in range(rounds):
        for row in sums(kept, books, width):
            books[row["part"]][row["entry"]] = [int(row[f"t{k}"]) // row["n"] for k in range(step)]
    trees = [Gnat(b) for b in books]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2), width)
            found = [tree.nearest(v[:, p * step : (p + 1) * step]) for p, tree in enumerate(trees)]
            codes = np.stack([index for index, _ in found], 1).astype(np.int32)
            errors = sum(error for _, error in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(codes), pa.list_(pa.int32())), pa.array(errors)], names=["_id", "_label", "codes", "error"]
            )

    types = found.schema
    out = f"_id {types['_id'].dataType.simpleString()}, _label {types['_label'].dataType.simpleString()}, codes array<int>, error long"
    return kept.mapInArrow(code, out), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """Add the error summed over the rows of a label, null being one; a label may hold any share of the rows."""
    keyed = coded.withColumn("_key", F.to_json(F.struct("_label")))
    totals = keyed.groupBy("_key").agg(F.sum("error").alias("label_error"))
    totals = written_table(totals, "label-errors")
    if fits_broadcast(totals):
        return keyed.join(F.broadcast(totals), "_key").drop("_key")
    return salted_join(keyed, totals, "_key", F.struct("_id", "codes")).drop("_key")
