"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): all grades share the weights of sparse text features, only the
thresholds differ and rise.  Features are the presence of words and of their beginnings, hashed; those whose
share differs between toxic and other labelled texts are kept.  The labels say toxic or not; no label says
how severe, so the severe grade is made here: toxic texts with more marks than the median of the toxic ones.  Output is each grade's probability and the
expected severity.

The model is fitted on at most about ``SAMPLE`` labelled rows, chosen by a hash of the id (a documented bound);
every row is scored.  A null or empty text has no features, and severity as the thresholds alone say.
Rows without label, with null labels or without a counterpart in the documents are not learned from.  Without toxic
labels nothing is toxic.  Repeated rows are scored singly; other columns pass through, but those named
``grade``, ``toxic`` or ``p_toxic`` are replaced.  Texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import ready_for_python
from newsloom.session import written_table

SAMPLE = 20_000
SPACE = 1 << 22
KEPT = 20_000  # features of the model at most
LEAST_Z = 3.5  # how many deviations the log odds of a feature must lie from 0
PREFIXES = (3, 4, 5)
GRADES = 3
CACHED = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")


def hashed(kind: int, part: str) -> int:
    return zlib.crc32(part.encode(), kind) % SPACE


def word_features(word: str) -> tuple[int, ...]:
    return (hashed(0, word), *(hashed(k, word[:k]) for k in PREFIXES if len(word) > k))


def vocabulary(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


class Ordinal:
    """Weights by feature and rising thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds
        self.known: dict[str, tuple[int, ...]] = {}

    def logit(self, text: str | None) -> float:
        """w.x; each feature counts once however many words have it."""
        found: set[int] = set()
        for word in vocabulary(text):
            ids = self.known.get(word)
            if ids is None:
                if len(self.known) >= CACHED:
                    self.known.clear()
                ids = self.known[word] = tuple(f for f in word_features(word) if f in self.weights)
            found.update(ids)
        return sum(self.weights[f] for f in sorted(found))

    def above(self, logit: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - logit[:, None], -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray, features: np.ndarray, steps: int = 400, decay: float = 1e-4) -> Ordinal:
    """Maximum likelihood by gradient steps; rows hold places in ``features``."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    places = np.concatenate(rows).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    weights, sums = np.zeros(len(features)), np.full(len(features), 1e-8)
    # thresholds are the first and the logarithms of the gaps, so they rise
    free, free_sums = np.array([1.0] + [0.0] * (GRADES - 2)), np.full(GRADES - 1, 1e-8)
    n = max(1, len(rows))
    for _ in range(steps):
        limits = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
        z = np.bincount(owner, weights[places], len(rows))
        below = 1 / (1 + np.exp(-np.clip(limits[None, :] - z[:, None], -30, 30)))
        edges = np.concatenate([np.zeros((len(rows), 1)), below, np.ones((len(rows), 1))], 1)
        i = np.arange(len(rows))
        p = np.maximum(edges[i, grades + 1] - edges[i, grades], 1e-12)
        slope = edges * (1 - edges)
        upper, lower = slope[i, grades + 1] / p, slope[i, grades] / p
        g_z = (upper - lower) / n
        g_w = np.bincount(places, g_z[owner], len(features)) + decay * weights
        g_limits = np.zeros(GRADES + 1)
        np.add.at(g_limits, grades + 1, -upper / n)
        np.add.at(g_limits, grades, lower / n)
        g_limits = g_limits[1:-1]
        g_free = np.array([g_limits.sum()] + [np.exp(free[k]) * g_limits[k:].sum() for k in range(1, GRADES - 1)])
        sums += g_w**2
        free_sums += g_free**2
        weights -= 0.3 * g_w / np.sqrt(sums)
        free -= 0.3 * g_free / np.sqrt(free_sums)
    limits = free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])
    return Ordinal({int(f): float(w) for f, w in zip(features, weights, strict=True) if w}, limits.tolist())


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, sample: int = SAMPLE) -> Ordinal | None:
    """The model, or none if the labels hold no toxic or no other text."""
    marks = labels.select(F.col(f"`{id_col}`").alias("_of"), F.col(f"`{label}`").cast("int").alias("_toxic")).dropna()
    marks = marks.groupBy("_of").agg(F.max("_toxic").alias("_toxic"))
    n = marks.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 20))
    chosen = marks.filter(F.pmod(F.xxhash64("_of"), F.lit(1 << 20)) < share)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array(sorted({f for w in vocabulary(t) for f in word_features(w)}), np.int32) for t in texts], dtype=object)

    # the sample is bounded, so it may go to every task and the texts stay where they are
    texts = docs.select(F.col(f"`{id_col}`").alias("_of"), F.col(f"`{text}`").alias("_text")).join(F.broadcast(chosen), "_of")
    rows = written_table(ready_for_python(texts).select("_toxic", F.pandas_udf(run, "array<int>")("_text").alias("features")), "labelled")
    sizes = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sum(v for k, v in sizes.items() if k > 0), sum(v for k, v in sizes.items() if k <= 0)
    if not toxic or not other:
        return None
    a, b = F.col("a"), F.col("b")
    seen = rows.select(F.explode("features").alias("f"), (F.col("_toxic") > 0).cast("long").alias("t")).groupBy("f").agg(
        F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b")
    )
    odds = F.log((a + 0.5) / (F.lit(toxic) - a + 0.5)) - F.log((b + 0.5) / (F.lit(other) - b + 0.5))
    spread = F.sqrt(1 / (a + 0.5) + 1 / (F.lit(toxic) - a + 0.5) + 1 / (b + 0.5) + 1 / (F.lit(other) - b + 0.5))
    picked = (
        seen.withColumn("z", odds / spread).filter((F.abs("z") >= LEAST_Z) & (a + b >= 3)).orderBy(F.desc(F.abs("z")), "f").limit(KEPT)
        .select("f", "z").collect()
    )
    features = np.array([r["f"] for r in picked], np.int64)
    positive = {r["f"] for r in picked if r["z"] > 0}
    place = {int(f): i for i, f in enumerate(features)}
    known = cut_down(rows, set(place))
    found, toxic_flags, marks_of = [], [], []
    for row in known.collect():  # the bounded sample, cut down to the chosen features
        found.append(np.array([place[f] for f in row["features"]], np.int64))
        toxic_flags.append(row["_toxic"] > 0)
        marks_of.append(sum(f in positive for f in row["features"]))
    flags, marks_of = np.array(toxic_flags), np.array(marks_of)
    grades = np.where(flags, 1 + (marks_of > np.median(marks_of[flags])), 0)
    return fit(found, grades, features)


def cut_down(rows: DataFrame, wanted: set[int]) -> DataFrame:
    """Rows with their features cut down to ``wanted`` (at most ``KEPT`` numbers, which travel with the tasks)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([[f for f in fs if f in wanted] for fs in lists], dtype=object)

    return rows.select("_toxic", F.pandas_udf(run, "array<int>")("features").alias("features"))


def grade(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, cut: float = 0.5
) -> DataFrame:
    """Add p_toxic, p_severe, expected_severity (0 to 2), grade (the most likely one) and toxic."""
    model = learn(docs, labels, id_col, text, label, sample)
    if model is None:
        zero = F.lit(0.0)
        return docs.withColumns(
            {"p_toxic": zero, "p_severe": zero, "expected_severity": zero, "grade": F.lit(0), "toxic": F.lit(False)}
        )
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            above = shipped.value.above(np.array([shipped.value.logit(t) for t in texts], float))
            each = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1), axis=1)
            yield pd.DataFrame(
                {"p_toxic": above[:, 0], "p_severe": above[:, 1], "expected_severity": above.sum(1), "grade": each.argmax(1), "toxic": above[:, 0] >= cut}
            )
        shipped.value.known.clear()  # workers live on

    kind = "p_toxic double, p_severe double, expected_severity double, grade int, toxic boolean"
    out = ready_for_python(docs).withColumn("_graded", F.pandas_udf(run, kind)(F.col(f"`{text}`")))
    return out.withColumns({c.split()[0]: F.col("_graded")[c.split()[0]] for c in kind.split(", ")}).drop("_graded")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their columns, whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    aside = docs.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text}`").alias("_t"), whole.alias("_row"))
    named = labels.select(F.col(f"`{id_col}`").alias("_i"), F.col(f"`{settings.pop('label', 'toxic')}`").alias("toxic"))
    return grade(aside, named, "_i", "_t", **settings).filter(~F.col("toxic")).select("_row.*")
