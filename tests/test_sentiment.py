import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from newsloom.operators import extremes, sentiment
from newsloom.operators import joins

LEXICON = [("gut", 0.5), ("gut", 0.25), ("schlecht", -0.7), ("Gut", 9.0), ("krise", -0.1234567)]


def lexicon(spark, entries=LEXICON):
    return spark.createDataFrame(entries, "word string, value double")


def articles(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "id long, body string")


def scores_of(df):
    return {r["id"]: r["score"] for r in df.collect()}


def test_scores(spark):
    bodies = ["GUT, gut und schlecht.", "nichts", None, "", "Krise"]
    assert scores_of(sentiment.lexicon_score(articles(spark, bodies), lexicon(spark))) == {
        0: 0.8, 1: 0.0, 2: 0.0, 3: 0.0, 4: -0.123457,
    }


def test_capitalised_entries_match_only_on_request(spark):
    df = articles(spark, ["gut"])
    assert scores_of(sentiment.lexicon_score(df, lexicon(spark), lowercase_lexicon=True)) == {0: 9.75}


def test_other_columns_ride_along(spark):
    df = spark.createDataFrame([(1, "x", "gut"), (2, None, None)], "id long, kicker string, body string")
    got = sentiment.lexicon_score(df, lexicon(spark), keep=("id", "kicker"))
    assert sorted(map(tuple, got.collect())) == [(1, "x", 0.75), (2, None, 0.0)]


words = st.lists(st.sampled_from(["gut", "Gut", "schlecht", "krise", "wort", "gut-"]), max_size=30)


@settings(max_examples=6, deadline=None)
@given(st.lists(words, min_size=1, max_size=6))
def test_equals_a_plain_count(spark, texts):
    bodies = [" ".join(t) for t in texts]
    expected = {}
    for i, body in enumerate(bodies):
        times = Counter(re.findall(r"\w+", body.lower()))
        expected[i] = round(sum(v * times[w] for w, v in LEXICON), 6)
    assert scores_of(sentiment.lexicon_score(articles(spark, bodies), lexicon(spark))) == pytest.approx(expected)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_partitioning_does_not_matter(spark, parts):
    df = articles(spark, ["gut schlecht gut", "krise", "wort", None] * 10).repartition(parts)
    got = scores_of(sentiment.lexicon_score(df, lexicon(spark)))
    assert sum(got.values()) == pytest.approx(10 * (0.8 - 0.123457))


def test_large_lexicon_gives_the_same(spark, monkeypatch):
    df = articles(spark, ["gut schlecht gut", "krise gut", None, "wort"] * 5)
    expected = scores_of(sentiment.lexicon_score(df, lexicon(spark)))
    monkeypatch.setattr(sentiment, "fits_broadcast", lambda _: False)
    shuffled = sentiment.lexicon_score(df, lexicon(spark))
    assert "_salt" in shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert scores_of(shuffled) == expected


def test_small_side_is_measured(spark):
    df = lexicon(spark)
    assert joins.fits_broadcast(df)
    assert not joins.fits_broadcast(df, max_rows=4)
    assert not joins.fits_broadcast(df, max_bytes=60)


@pytest.mark.parametrize("total", [1, 2, 3, 10, 101, 5000])
def test_exact_quantiles_of_any_size(spark, total):
    rng = np.random.default_rng(total)
    values = np.round(rng.normal(size=total) * (rng.integers(0, 3, total)), 2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(5)
    row = extremes.exact_quantiles(df, "v").first()
    assert (row.low, row.high) == pytest.approx(tuple(np.quantile(values, [0.05, 0.95])), abs=1e-9)
    grouped = extremes.group_quantiles(df, "v").first()
    assert (grouped.low, grouped.high) == pytest.approx((row.low, row.high), abs=1e-9)


def test_exact_quantiles_with_one_value_in_most_rows(spark):
    values = [0.0] * 900 + [float(i) for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    row = extremes.exact_quantiles(df, "v").first()
    assert (row.low, row.high) == pytest.approx(tuple(np.quantile(values, [0.05, 0.95])))


VALUES = {
    "equal": [3.25] * 500,
    "zeros": [0.0, -0.0] * 40 + [1e-320, -1e-320],
    "all sizes": [s * 10.0**e for e in range(-300, 300, 7) for s in (1, -1, 3)],
    "neighbours": [1.0 + k * 2.0**-52 for k in range(300)] + [2.0 - 2.0**-52, 2.0],
    "few far": [1.0] * 300 + [1e300, -1e300, float("inf"), float("-inf")],
    "powers": [2.0**k for k in range(-1070, 1023, 3)],
}


@pytest.mark.parametrize("name", VALUES)
def test_radix_selection_finds_every_rank(spark, name):
    df = spark.createDataFrame([(v,) for v in VALUES[name]] + [(None,)], "v double").repartition(3)
    total, found = extremes.values_at(df, "v", None, lambda n: range(0, n, max(1, n // 40)))
    assert total == len(VALUES[name]) and found == {r: sorted(VALUES[name])[r] for r in range(0, total, max(1, total // 40))}


def test_radix_selection_of_random_values(spark):
    values = np.random.RandomState(2).standard_cauchy(20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)
    want = np.quantile(values, [0.05, 0.5, 0.95])
    assert list(extremes.exact_quantiles(df, "v", probs=(0.05, 0.5, 0.95)).first()["q"]) == pytest.approx(list(want), abs=1e-9)
    nothing = extremes.exact_quantiles(df.filter("v is null"), "v").first()
    assert (nothing.low, nothing.high) == (None, None)
    odd = spark.createDataFrame([(1.0, 2), (float("nan"), 1), (2.0, 0), (3.0, None)], "v double, n int")
    total, found = extremes.values_at(odd, "v", "n", range)
    assert total == 3 and found[0] == found[1] == 1.0 and found[2] != found[2]


def test_quantiles_neither_sort_nor_sample(spark, monkeypatch):
    """Only rows of the buckets that hold wanted ranks are written."""
    df = spark.range(100_000).select((F.col("id") * 0.37).alias("v"))
    sizes = []
    plain = extremes.written_table
    monkeypatch.setattr(extremes, "written_table", lambda d, name: sizes.append(plain(d, name)) or sizes[-1])
    row = extremes.exact_quantiles(df, "v").first()
    assert (row.low, row.high) == pytest.approx((4999.95 * 0.37, 94999.05 * 0.37))
    assert len(sizes) == 1 and sizes[0].count() < 3000


def test_weights_repeat_rows(spark):
    df = spark.createDataFrame([(1.0, 7), (2.0, 1), (5.0, 3)], "v double, n long")
    row = extremes.group_quantiles(df, "v", weight="n").first()
    expected = np.quantile([1.0] * 7 + [2.0] + [5.0] * 3, [0.05, 0.95])
    assert (row.low, row.high) == pytest.approx(tuple(expected))


def labels(spark, values, floor):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    return [r["sentiment"] for r in extremes.classify_extremes(df, "v", floor).orderBy("v").collect()]


def test_labels_need_to_pass_quantile_and_floor(spark):
    spread = [-30, -5, *range(0, 20), 25, 40]
    assert labels(spark, spread, 1)[0] == "negativ" and labels(spark, spread, 1)[-1] == "positiv"
    assert labels(spark, spread, 1).count("neutral") >= 20
    assert set(labels(spark, [-0.9, 0.0, 0.9], 1)) == {"neutral"}
    assert labels(spark, [-0.9, 0.0, 0.9], 0) == ["negativ", "neutral", "positiv"]


def test_comparison_is_strict(spark):
    assert labels(spark, [1.0, 1.0, 1.0], 1) == ["neutral"] * 3
    assert labels(spark, [2.0, 2.0], 0) == ["neutral"] * 2


@pytest.mark.parametrize("probs", [(0.5,), (0.1, 0.5, 0.9), (0.0, 0.25, 0.5, 0.75, 1.0)])
def test_any_list_of_quantiles(spark, probs):
    df = spark.range(101).select((F.col("id") * 1.0).alias("v"), (F.col("id") % 3).alias("n"))
    want = [100 * p for p in probs]
    assert list(extremes.exact_quantiles(df, "v", probs=probs).first()["q"]) == want
    assert list(extremes.group_quantiles(df, "v", probs=probs).first()["q"]) == want
    weighted = [f(df, "v", weight="n", probs=probs).first()["q"] for f in (extremes.exact_quantiles, extremes.group_quantiles)]
    assert weighted[0] == pytest.approx(weighted[1])
