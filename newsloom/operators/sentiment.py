"""Lexicon scores per article."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.scores import score_rounding
from newsloom.functions.text import WORD_BOUNDARIES, word_tokens
from newsloom.operators.joins import fits_broadcast, salted_join

PARTS = 16  # of the texts of one key


def article_words(
    articles: DataFrame, *keep: str, text: str = "body", pattern: str = WORD_BOUNDARIES
) -> DataFrame:
    """One row per word of each whole article; an article without words keeps one null word."""
    return articles.select(
        *keep, F.explode_outer(word_tokens(F.col(text), pattern)).alias("word")
    )


def lexicon_hits(words: DataFrame, lexicon: DataFrame, how: str = "inner") -> DataFrame:
    """Words joined with the lexicon; a word listed twice there counts twice."""
    entries = lexicon.select("word", "value")
    if fits_broadcast(entries):
        return words.join(F.broadcast(entries), "word", how)
    rest = [c for c in words.columns if c != "word"]
    return salted_join(words, entries, "word", F.xxhash64(*rest), how)


def lexicon_score(
    articles: DataFrame,
    lexicon: DataFrame,
    keep: Sequence[str] = ("id",),
    text: str = "body",
    pattern: str = WORD_BOUNDARIES,
    lowercase_lexicon: bool = False,
    out: str = "score",
) -> DataFrame:
    """Sum of lexicon values per article, 0 without a hit, rounded to six decimals.

    ``keep`` starts with the article's unique key; the other columns in it ride along, so no join
    back to the articles is needed.  All words of an article sit in one input partition, so the
    partial sum leaves one row per article to shuffle.

    A lexicon measured as too large for a broadcast is joined by word instead, after counting
    equal words per article and with the frequent words spread by article key.
    """
    entries = lexicon.select("word", "value")
    if lowercase_lexicon:
        entries = entries.withColumn("word", F.lower("word"))
    if not fits_broadcast(entries):
        return lexicon_score_shuffled(articles, entries, keep, text, pattern, out)
    words = article_words(articles, *keep, text=text, pattern=pattern)
    points = words.join(F.broadcast(entries), "word", "left")  # measured above
    return points.groupBy(*keep).agg(
        score_rounding(F.coalesce(F.sum("value"), F.lit(0.0))).alias(out)
    )


def lexicon_score_shuffled(
    articles: DataFrame,
    lexicon: DataFrame,
    keep: Sequence[str] = ("id",),
    text: str = "body",
    pattern: str = WORD_BOUNDARIES,
    out: str = "score",
) -> DataFrame:
    """The same score for a lexicon of any size.

    Texts move once, before they are cut into words, so that equal words of an article are counted where they are: a text is
    several times smaller than the rows of its words.  A key that repeats is dealt by its texts; its parts are added up at the end.
    """
    part = F.pmod(F.xxhash64(F.col(text)), F.lit(PARTS)).cast("int").alias("_part")
    placed = articles.select(*keep, F.col(text).alias("_text"), part).repartition(keep[0], "_part")
    words = article_words(placed, *keep, "_part", text="_text", pattern=pattern)
    counted = words.groupBy(*keep, "_part", "word").agg(F.count(F.lit(1)).alias("_times"))
    values = lexicon.groupBy("word").agg(F.sum("value").alias("value"))
    points = salted_join(counted.drop("_part"), values, "word", F.col(keep[0]), "left")
    total = F.sum(F.col("value") * F.col("_times"))
    return points.groupBy(*keep).agg(
        score_rounding(F.coalesce(total, F.lit(0.0))).alias(out)
    )
