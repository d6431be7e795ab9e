import datetime as dt
from collections import Counter

import pytest

from newsloom import schemas
from newsloom.plans import presets
from newsloom.plans import sentiment as plans

D1, D2, D3 = dt.date(2020, 1, 6), dt.date(2020, 1, 7), dt.date(2020, 1, 8)
LEXICON = [("gut", 2.0), ("schlecht", -2.0)]


def articles(spark, rows):
    """rows: (pubdate, kicker, origins, title, body)"""
    return spark.createDataFrame(
        [(i, d, k, o, t, None, b) for i, (d, k, o, t, b) in enumerate(rows)],
        "id long, pubdate date, kicker string, origins string, title string, subtitle string, body string",
    )


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEXICON, schemas.LEXICON)


def test_party_sentiment(spark, lexicon, rows):
    df = articles(
        spark,
        [(D1, "", "", "", "Die ÖVP ist gut"), (D1, "", "", "", "Österreichische Volkspartei: gut, gut"),
         (D1, "", "", "", "ÖVP und SPÖ gut"), (D1, "", "", "", "Sozialdemokratische Partei Österreichs schlecht"),
         (D2, "", "", "", "Die Grünen"), (D2, "", "", "", None), (D2, "", "", "", "FPÖler"), (D2, "", "", "", "Grüner Grüne!")],
    )
    got = plans.exclusive_tag_sentiment(df, lexicon)
    assert rows(got, "pubdate", "party", "n", "percentage", "sum_sentiment", "sentiment") == [
        (D1, "SPÖ", 1, 1.0, -2.0, "negativ"), (D1, "ÖVP", 2, 1.0, 6.0, "positiv"), (D2, "Grüne", 2, 1.0, 0.0, "neutral"),
    ]


def test_institution_in_any_column(spark, lexicon, rows):
    df = articles(
        spark,
        [(D1, "k", "ann", "OeNB warnt", "gut"), (D1, "k", "bob", None, "die OeNB schlecht"), (D1, "k", "eve", "x", "OeNBs gut"),
         (D2, "k", None, "x", "OeNB"), (D2, "k", "sonstiges", "x", "OeNB gut")],
    )
    got = plans.institution_sentiment_by_author(df, lexicon)
    assert rows(got, "pubdate", "new_kicker", "sum_sentiment") == [(D1, "ann", 2.0), (D1, "bob", -2.0)]


def test_person_leaves_blank_topics_out(spark, lexicon, rows):
    df = articles(spark, [(D1, "", "", "Sebastian Kurz", "gut"), (D1, "a", "", "", "Sebastian Kurzens"), (D1, "a", "", "", "kurz")])
    assert rows(plans.person_sentiment_by_kicker(df, lexicon), "new_kicker", "n") == [("a", 1)]


def test_terms_need_no_boundary(spark, lexicon, rows):
    df = articles(spark, [(D1, "a", "", "", "ÖVPler gut"), (D1, "a", "", "", "Volksparteien"), (D1, "b", "", "", "SPÖ")])
    assert rows(plans.term_sentiment_by_kicker(df, lexicon), "new_kicker", "n", "sum_sentiment") == [("a", 2, 2.0)]


def market_rows():
    market = [(D1, "a", "", "", "Börse gut")] * 3 + [(D1, None, "", "", "X-Aktien schlecht"), (D2, "b", "", "", "Rezessionsangst schlecht schlecht")]
    return market + [(D3, "a", "", "", "ATX gut"), (D1, "a", "", "", "Börsen"), (D2, "c", "", "", "Kapitalmarkt")]


def test_market_gives_one_row_per_article(spark, lexicon):
    prices = spark.createDataFrame([(D1, 100.0), (D2, 110.0)], schemas.PRICES)
    got = plans.market_articles_with_index(articles(spark, market_rows()), lexicon, prices)
    assert got.columns == ["pubdate", "new_kicker", "n", "percentage", "sum_sentiment", "atx", "sentiment"]
    # D3 has no price; the null topic is dropped only after the quantiles
    assert Counter(tuple(r) for r in got.collect()) == {
        (D1, "a", 3, 1.0, 6.0, 100.0, "neutral"): 3,
        (D2, "b", 1, 1.0, -4.0, 110.0, "negativ"): 1,
        (D2, "c", 1, 1.0, 0.0, 110.0, "neutral"): 1,
    }


def test_market_with_two_prices_a_day_and_no_price(spark, lexicon):
    prices = spark.createDataFrame([(D1, 100.0), (D1, 101.0), (D2, None)], schemas.PRICES)
    got = Counter(tuple(r) for r in plans.market_articles_with_index(articles(spark, market_rows()), lexicon, prices).collect())
    assert got == {(D1, "a", 6, 1.0, 12.0, 100.0, "neutral"): 3, (D1, "a", 6, 1.0, 12.0, 101.0, "neutral"): 3}


def test_market_lumps_and_measures_prices(spark, lexicon, monkeypatch):
    prices = spark.createDataFrame([(D1, 100.0), (D2, 110.0), (D3, 120.0)], schemas.PRICES)
    df = articles(spark, market_rows())
    expected = Counter(map(tuple, plans.market_articles_with_index(df, lexicon, prices, k=1).collect()))
    assert {r[1] for r in expected} == {"a", "sonstiges"}
    monkeypatch.setattr(plans, "fits_broadcast", lambda _: False)
    assert Counter(map(tuple, plans.market_articles_with_index(df, lexicon, prices, k=1).collect())) == expected


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_partitioning_does_not_matter(spark, lexicon, rows, parts):
    df = articles(spark, market_rows() * 5)
    got = plans.term_sentiment_by_kicker(df.repartition(parts), lexicon, terms=("gut", "schlecht"))
    assert rows(got) == rows(plans.term_sentiment_by_kicker(df.coalesce(1), lexicon, terms=("gut", "schlecht")))


def test_presets_are_complete():
    assert set(presets.PARTY_NAMES) == set(presets.PARTY_PATTERNS)
