"""Collecting articles: growing the frontier, extracting pending pages, cleaning, scoring."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.operators import dedup, extract, frontier, scoring
from newsloom.operators.joins import join_checked, repeat_rows
from newsloom.session import written_table
from newsloom.sources import sinks


def grow_frontier(
    articles: DataFrame,
    pages: DataFrame,
    known: DataFrame,
    base: str,
    today: dt.date | None = None,
    container: str = "article",
) -> DataFrame:
    """The frontier plus the links on the front pages of all days since the newest article."""
    days = frontier.front_page_dates(frontier.high_water_mark(articles), today=today, base=base)
    # a few thousand days at most: the calendar bounds this side
    fronts = pages.join(days.select("url").hint("broadcast"), "url", "left_semi")
    links = extract.extract_links(fronts, container)
    return frontier.append_frontier(known, frontier.new_entries(links, today))


def collect_articles(
    known: DataFrame,
    collected: DataFrame,
    pages: DataFrame,
    base: str,
    fields: Sequence[extract.Field] = extract.ARTICLE_FIELDS,
    newest: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New article rows (without keys) and the frontier with outcomes; runs jobs at once.

    Addresses of ``pages`` are relative to ``base``.  Of several pages of one address the one with the largest ``newest`` counts (of
    those, and without that column, one that only their content decides).  Every pending page is parsed once and stored; an address that
    is pending twice gives two article rows, one whose page is not stored stays pending.
    """
    waiting = frontier.pending(frontier.todo(known), collected, base)
    wanted = written_table(waiting.groupBy("url").count(), "wanted")
    age = F.col(newest) if newest else F.lit(0)
    needed = join_checked(pages.select("url", "html", age.alias("_age"), F.xxhash64("html").alias("_of")), wanted, "url")
    parsed = written_table(extract.read_articles(needed, fields), "parsed")
    # fields are chosen, not pages, and one row per address and task at most moves
    latest = Window.partitionBy("url").orderBy(F.desc("_age"), "_of")
    read = parsed.withColumn("_place", F.row_number().over(latest)).filter("_place = 1").drop("_place", "_age", "_of")
    read = written_table(read, "read")
    results = written_table(frontier.outcomes(read), "outcomes")
    found = extract.accepted(read)
    again = repeat_rows(found.filter(F.col("count") > 1), "count")
    new = found.filter(F.col("count") == 1).drop("count").unionByName(again)
    return new, frontier.apply_outcomes(known, results)


def store_articles(spark: SparkSession, table: str, location: str, new: DataFrame) -> None:
    sinks.create_if_absent(spark, table, location)
    sinks.append_articles(spark, table, new)


def clean_articles(articles: DataFrame) -> DataFrame:
    """Without duplicates by title and subtitle."""
    return dedup.dedup_second_oldest(articles)


def model_sentiment(articles: DataFrame, load: Callable[[], scoring.Scorer]) -> DataFrame:
    """Articles with the model's label where none was stored."""
    return scoring.score_missing(articles, load)
