"""Model scores for articles that have none yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.scores import class_label, softmax
from newsloom.operators.joins import join_checked
from newsloom.session import small_batches

# A scorer takes a list of texts and returns one list of class scores per text.
Scorer = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def word_count(text: str) -> int:
    return len(text.split())


def like_sized(texts: Sequence[str], rows: int, size: Callable[[str], int] = word_count) -> list[list[int]]:
    """Places of the texts in batches of ``rows`` whose sizes are near each other, so that padding to a batch's largest one adds little."""
    order = sorted(range(len(texts)), key=[size(t) for t in texts].__getitem__)
    return [order[k : k + rows] for k in range(0, len(order), rows)]


def padded(sizes: Sequence[int], batches: Sequence[Sequence[int]]) -> int:
    """Tokens a model works on if each batch is padded to its largest text."""
    return sum(len(b) * max(sizes[i] for i in b) for b in batches)


def logits_of(
    df: DataFrame,
    load: Callable[[], Scorer],
    text: str = "body",
    out: str = "logits",
    where: Column | None = None,
    rows: int = 32,
    size: Callable[[str], int] = word_count,
) -> DataFrame:
    """Class scores per row, null where ``where`` does not hold.

    ``load`` runs once per task and returns the scorer; the scorer brings its own tokenizer and
    input limit, and gets ``rows`` texts of like ``size`` at a time, whatever their order in the table.  Only the text column goes to Python.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = load()
        for texts in batches:
            found: list[list[float] | None] = [None] * len(texts)
            given = [k for k, t in enumerate(texts) if t is not None]
            asked = [texts.iloc[k] for k in given]
            for batch in like_sized(asked, rows, size):
                for i, scores in zip(batch, scorer([asked[i] for i in batch]), strict=True):
                    found[given[i]] = list(map(float, scores))
            yield pd.Series(found, dtype="object")

    # marked so that a filter on the result never runs the model twice
    return small_batches(df).withColumn(out, score.asNondeterministic()(where_text(text, where)))


def where_text(text: str, where: Column | None) -> Column:
    """What the scorer gets: the text, "" for null; null, which it never sees, where it is not asked."""
    given = F.coalesce(F.col(text), F.lit(""))
    return given if where is None else F.when(where, given)


def add_column_if_absent(df: DataFrame, column: str, kind: str = "double") -> DataFrame:
    if column in df.columns:
        return df
    return df.withColumn(column, F.lit(None).cast(kind))


def unscored(df: DataFrame, column: str = "sentiment") -> DataFrame:
    return df.filter(F.col(column).isNull())


def score_missing(
    df: DataFrame,
    load: Callable[[], Scorer],
    text: str = "body",
    column: str = "sentiment",
    labels: dict[int, float] | None = None,
) -> DataFrame:
    """Fill missing sentiment from the model and leave the rest alone.

    One pass: the model gets the texts of unscored rows only, and no row is shuffled to merge the new values.
    """
    full = add_column_if_absent(df, column)
    fresh = logits_of(full, load, text, "_logits", F.col(column).isNull())
    label = F.when(F.col("_logits").isNotNull(), class_label(softmax(F.col("_logits")), labels))
    return fresh.withColumn(column, F.coalesce(F.col(column), label)).drop("_logits")


def update_by_key(
    df: DataFrame, updates: DataFrame, key: str = "id", column: str = "sentiment"
) -> DataFrame:
    """Set ``column`` where ``updates`` has the key; of several updates of a key the largest value counts."""
    values = updates.groupBy(key).agg(F.max(column).alias("_new"), F.lit(True).alias("_hit"))
    joined = join_checked(df, values, key, "left")
    return joined.withColumn(
        column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))
    ).select(*df.columns)
