"""Numeric columns: model probabilities, model labels, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which class index of the model means what; other classes are neutral (0).
# On equal probabilities the earlier entry wins.
CLASS_LABELS = {1: 1.0, 2: -1.0}

# Fixed value: decimals kept when a score passes through its text form.
SCORE_DECIMALS = 6


def softmax(logits: Column) -> Column:
    peak = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp((x - peak).cast("double")))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: x / total)


def class_label(probabilities: Column, labels: dict[int, float] | None = None) -> Column:
    """The label of the most probable class; null stays null."""
    best = F.array_max(probabilities)
    chosen = F.when(probabilities.isNull(), F.lit(None).cast("double"))
    for index, label in (labels or CLASS_LABELS).items():
        chosen = chosen.when(F.get(probabilities, F.lit(index)) == best, F.lit(float(label)))
    return chosen.otherwise(F.lit(0.0))


def score_rounding(value: Column) -> Column:
    return F.round(value, SCORE_DECIMALS)
