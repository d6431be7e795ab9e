"""Tagging articles by regular expressions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import matches_any


def tag(
    df: DataFrame,
    patterns: Mapping[str, str],
    columns: Iterable[str] = ("body",),
) -> DataFrame:
    """One boolean column per pattern, true if any of ``columns`` matches it."""
    return df.withColumns({name: matches_any(columns, p) for name, p in patterns.items()})


def tag_count(flags: Iterable[str]) -> Column:
    counted = [F.col(flag).cast("int") for flag in flags]
    return sum(counted[1:], counted[0])


def first_label(labels: Mapping[str, str]) -> Column:
    """Label of the first true flag; null if none is."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for flag, label in labels.items():
        chosen = chosen.when(F.col(flag), F.lit(label))
    return chosen


def exclusive_tag(df: DataFrame, labels: Mapping[str, str], out: str = "label") -> DataFrame:
    """Rows carrying exactly one of the flags, named by it (not by ""); the flags are dropped.

    Filter and label come from one generated column: as two steps the optimizer would evaluate
    every pattern twice.
    """
    found = F.array_remove(
        F.array(*[F.when(F.col(flag), label).otherwise("") for flag, label in labels.items()]), ""
    )
    kept = [c for c in df.columns if c not in labels]
    only = F.when(F.size(found) == 1, found)
    return df.select(*kept, F.explode_outer(only).alias(out)).filter(F.col(out).isNotNull())
