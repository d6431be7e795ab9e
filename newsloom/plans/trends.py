"""Counts over time: topic shares per week, author activity per day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.dates import day, week
from newsloom.operators.counts import count_by, exclude, keep_top, named_only, share_within, top_k
from newsloom.plans import presets


def weekly_label_share(
    articles: DataFrame, label: str = "kicker", k: int = presets.TOP_TOPICS, out: str = "new_kicker"
) -> DataFrame:
    """Articles per week and top-k topic, and the share among these topics in the week.

    The articles are reduced once to (week, topic) counts; the top-k list and the result both
    come from those.
    """
    weekly = count_by(articles, week(F.col("pubdate")).alias("week"), label)
    top = named_only(top_k(weekly, label, k, weight="n"), label)
    kept = keep_top(weekly, top, label).withColumnRenamed(label, out)
    return share_within(kept, "n", "week", calendar=True)


def author_daily_activity(
    articles: DataFrame,
    k: int = presets.TOP_AUTHORS,
    excluded: Sequence[str] = presets.AGENCY_ORIGINS,
    first_year: int = presets.FIRST_YEAR,
) -> DataFrame:
    """Articles per day and author, for the top-k authors of all time minus excluded names."""
    daily = count_by(articles, day(F.col("pubdate")).alias("day"), "origins")
    top = exclude(top_k(daily, "origins", k, weight="n"), "origins", excluded)
    # Tied to the count so that it stays above the shared aggregate instead of splitting the scan.
    in_range = F.coalesce((F.col("day") >= F.lit(dt.date(first_year, 1, 1))).cast("int"), F.lit(0))
    recent = F.col("n") * in_range > 0
    return keep_top(daily.filter(recent), top, "origins")
