"""Lexicon sentiment per day and group, with unusual days labelled.

Each plan reads the articles once: tag, score, reduce to (day, label) and write that small table;
the top-k list, the quantiles and the result are taken from it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import WORD_BOUNDARIES, any_of, matches_any
from newsloom.operators.counts import keep_top, lump, named_only, share_within, top_k
from newsloom.operators.extremes import classify_extremes
from newsloom.operators.joins import fits_broadcast, repeat_rows
from newsloom.operators.sentiment import lexicon_score
from newsloom.operators.tags import exclusive_tag, tag
from newsloom.plans import presets
from newsloom.session import written_table


def daily_scores(
    tagged: DataFrame, lexicon: DataFrame, label: str, pattern: str = WORD_BOUNDARIES
) -> DataFrame:
    """Articles and summed scores per day and label."""
    scored = lexicon_score(tagged, lexicon, keep=("id", "pubdate", label), pattern=pattern)
    return scored.groupBy("pubdate", label).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("sum_sentiment")
    )


def with_constant_share(groups: DataFrame) -> DataFrame:
    """The share of a group in itself: 1 for every group."""
    return groups.withColumn("percentage", F.col("n") / F.col("n"))


def with_share_of_day(groups: DataFrame) -> DataFrame:
    """Next to the constant share, a group's share of its day's articles."""
    return share_within(groups, "n", "pubdate", "share_of_day", calendar=True)


def exclusive_tag_sentiment(
    articles: DataFrame,
    lexicon: DataFrame,
    patterns: Mapping[str, str] = presets.PARTY_PATTERNS,
    names: Mapping[str, str] = presets.PARTY_NAMES,
    floor: float = 1,
    out: str = "party",
    word_pattern: str = WORD_BOUNDARIES,
) -> DataFrame:
    """Sentiment per day and party over articles that name exactly one party."""
    tagged = exclusive_tag(tag(articles, patterns), names, out)
    daily = written_table(daily_scores(tagged, lexicon, out, word_pattern), "daily")
    groups = with_constant_share(daily)
    return classify_extremes(groups, "sum_sentiment", floor)


def tagged_sentiment(
    articles: DataFrame,
    lexicon: DataFrame,
    where: Column,
    label: str = "kicker",
    k: int = presets.TOP_SENTIMENT,
    floor: float = 0,
    drop_blank: bool = False,
    out: str = "new_kicker",
    word_pattern: str = WORD_BOUNDARIES,
) -> DataFrame:
    """Sentiment per day and top-k label over the articles selected by ``where``."""
    daily = written_table(daily_scores(articles.filter(where), lexicon, label, word_pattern), "daily")
    top = named_only(top_k(daily, label, k, weight="n"), label, blank=not drop_blank)
    groups = with_constant_share(keep_top(daily, top, label).withColumnRenamed(label, out))
    return classify_extremes(groups, "sum_sentiment", floor)


def term_sentiment_by_kicker(
    articles: DataFrame,
    lexicon: DataFrame,
    terms: Sequence[str] = presets.PARTY_TERMS,
    k: int = presets.TOP_TOPICS,
    floor: float = 1,
) -> DataFrame:
    """Articles whose body contains one of the terms, by topic."""
    where = matches_any(["body"], any_of(terms))
    return tagged_sentiment(articles, lexicon, where, "kicker", k, floor)


def institution_sentiment_by_author(
    articles: DataFrame, lexicon: DataFrame, pattern: str = presets.BANK_PATTERN, k: int = presets.TOP_SENTIMENT,
) -> DataFrame:
    """Articles that name an institution anywhere in body, title or subtitle, by author."""
    where = matches_any(["body", "title", "subtitle"], pattern)
    return tagged_sentiment(articles, lexicon, where, "origins", k)


def person_sentiment_by_kicker(
    articles: DataFrame, lexicon: DataFrame, pattern: str = presets.PERSON_PATTERN, k: int = presets.TOP_SENTIMENT,
) -> DataFrame:
    """Articles that name a person anywhere, by topic; blank topics are left out."""
    where = matches_any(["body", "title", "subtitle"], pattern)
    return tagged_sentiment(articles, lexicon, where, "kicker", k, drop_blank=True)


def market_articles_with_index(
    articles: DataFrame,
    lexicon: DataFrame,
    prices: DataFrame,
    pattern: str = presets.MARKET_PATTERN,
    k: int = presets.TOP_SENTIMENT,
    floor: float = 0,
    out: str = "new_kicker",
    price: str = "atx",
    word_pattern: str = WORD_BOUNDARIES,
) -> DataFrame:
    """One row per market article on a trading day: the values of its day and topic, and the price.

    Days without a price leave before any text is split into words.  Quantiles weigh each group
    by its articles, as if taken over the article rows; incomplete rows are dropped after them.
    """
    market = articles.filter(matches_any(["body"], pattern))
    prices = written_table(prices, "prices")  # usually an aggregate; measured, listed and joined from here
    trading = prices.select(F.col("date").alias("pubdate")).distinct()
    if fits_broadcast(prices):
        market = market.join(F.broadcast(trading), "pubdate", "left_semi")
    daily = daily_scores(market, lexicon, "kicker", word_pattern)
    priced = daily.join(prices, daily["pubdate"] == prices["date"]).select(
        daily["*"], F.col("close").alias(price)
    )
    priced = written_table(priced, "priced")
    lumped = lump(priced, top_k(priced, "kicker", k, weight="n"), "kicker", out)
    keys = ["pubdate", out]
    # per price value: how many article rows carry it; per group: the values shown on each row
    rows = lumped.groupBy(*keys, price).agg(
        F.sum("n").alias("_rows"), F.sum("sum_sentiment").alias("_sum")
    )
    groups = rows.groupBy(*keys).agg(
        F.sum("_rows").alias("n"), F.round(F.sum("_sum"), 6).alias("sum_sentiment")
    )
    classified = classify_extremes(with_constant_share(groups), "sum_sentiment", floor, weight="n")
    pairs = rows.select(F.col("pubdate").alias("_d"), F.col(out).alias("_l"), price, "_rows")
    full = classified.join(
        pairs, (F.col("pubdate") == F.col("_d")) & F.col(out).eqNullSafe(F.col("_l"))
    )
    return repeat_rows(
        full.select(*keys, "n", "percentage", "sum_sentiment", price, "sentiment", "_rows"), "_rows"
    ).dropna("any")
