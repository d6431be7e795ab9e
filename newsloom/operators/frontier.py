"""The table of known addresses: which days, which links, what is pending, what came of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.dates import day, day_path, stored_time
from newsloom.functions.text import absolute_url
from newsloom.operators import bloom
from newsloom.operators.joins import fits_broadcast, join_checked

# Fixed values of ``downloaded``.
TODO, DONE, FAILED = 0, 1, 2


def high_water_mark(df: DataFrame, column: str = "pubdate", out: str = "newest") -> DataFrame:
    """The newest time; times kept as text are read first."""
    text = isinstance(df.schema[column].dataType, T.StringType)
    return df.agg(F.max(stored_time(F.col(column)) if text else column).alias(out))


def _date(value: dt.date | Column | None) -> Column:
    if value is None:
        return F.current_date()
    return value if isinstance(value, Column) else F.lit(value)


def front_page_dates(
    newest: DataFrame, column: str = "newest", today: dt.date | None = None, base: str = ""
) -> DataFrame:
    """Days after the newest stored one up to the day after ``today``, with page addresses.

    Nothing when the newest day lies after today or there is none.
    """
    now = _date(today)
    start = newest.select(day(F.col(column)).alias("_from"))
    days = start.filter(F.col("_from") <= now).select(
        F.explode(
            F.sequence(F.date_add("_from", 1), F.date_add(now, 1), F.expr("interval 1 day"))
        ).alias("date")
    )
    return days.withColumn("url", absolute_url(base, day_path(F.col("date"))))


def dates_since(spark, start: dt.date, today: dt.date | None = None, base: str = "") -> DataFrame:
    """The same days for a fixed start."""
    return front_page_dates(spark.range(1).select(F.lit(start).alias("newest")), "newest", today, base)


def as_frontier(urls: DataFrame) -> DataFrame:
    """The full form of an older frontier: no day, nothing downloaded yet."""
    full = urls
    if "datum" not in urls.columns:
        full = full.withColumn("datum", F.lit(None).cast("date"))
    state = F.col("downloaded") if "downloaded" in urls.columns else F.lit(None)
    return full.select("url", "datum", F.coalesce(state.cast("int"), F.lit(TODO)).alias("downloaded"))


def new_entries(links: DataFrame, run_date: dt.date | None = None) -> DataFrame:
    """Links as frontier rows: found on the day of the run, not yet downloaded."""
    return links.select(
        "url", _date(run_date).alias("datum"), F.lit(TODO).cast("int").alias("downloaded")
    )


def append_frontier(frontier: DataFrame, entries: DataFrame) -> DataFrame:
    """Old rows, then new ones; repeated addresses stay.  Either may be the older form of addresses only."""
    return as_frontier(frontier).unionByName(as_frontier(entries))


def todo(frontier: DataFrame) -> DataFrame:
    return frontier.filter(F.col("downloaded") == TODO)


def without_absolute(frontier: DataFrame, base: str) -> DataFrame:
    """Drop addresses that contain the site's own base (live tickers)."""
    return frontier.filter(~F.col("url").contains(base))


def not_collected(frontier: DataFrame, collected: DataFrame) -> DataFrame:
    """Drop addresses that already have an article.

    Few stored addresses (measured) are broadcast; beyond that a Bloom filter of them is, and only rows that may have an article move.
    """
    stored = collected.select("url")
    if fits_broadcast(stored):
        return frontier.join(F.broadcast(stored.dropna().distinct()), "url", "left_anti")
    return bloom.without_keys(frontier, stored, "url")


def pending(frontier: DataFrame, collected: DataFrame, base: str) -> DataFrame:
    """Addresses to work on: present, relative, not yet collected."""
    usable = without_absolute(frontier.dropna(subset=["url"]), base)
    return not_collected(usable, collected)


def outcomes(read: DataFrame) -> DataFrame:
    """One row per address whose page was read; it failed if every reading was rejected.

    An address whose page is not stored yet has no outcome and stays to do.
    """
    return read.groupBy("url").agg((~F.max("ok")).alias("failed"))


def apply_outcomes(frontier: DataFrame, results: DataFrame) -> DataFrame:
    """Pending rows become done or failed; a failed address is nulled on every row that has it."""
    per_url = results.groupBy("url").agg(F.max("failed").alias("failed"))
    joined = join_checked(frontier, per_url, "url", "left", collapse=True, bound=results)
    tried = (F.col("downloaded") == TODO) & F.col("failed").isNotNull()
    return joined.select(
        F.when(~F.coalesce(F.col("failed"), F.lit(False)), F.col("url")).alias("url"),
        "datum",
        F.when(tried & F.col("failed"), F.lit(FAILED))
        .when(tried, F.lit(DONE))
        .otherwise(F.col("downloaded"))
        .cast("int")
        .alias("downloaded"),
    )


def forget_url(frontier: DataFrame, url: str) -> DataFrame:
    """Drop one address; rows without an address stay."""
    return frontier.filter(~F.coalesce(F.col("url") == url, F.lit(False)))
