import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsloom.functions import dates, scores, text
from newsloom.plans import presets


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "given_text, words",
    [
        ("Die ÖVP hat's gesagt.", ["die", "övp", "hat's", "gesagt"]),
        ("3,5 Prozent z.B. über 1.000 A380", ["3,5", "prozent", "z.b", "über", "1.000", "a380"]),
        ("Aktien-Kurse (ATX)!", ["aktien", "kurse", "atx"]),
        ("a.5 5.a x,y", ["a", "5", "5", "a", "x", "y"]),
        ("...", []),
        ("", []),
    ],
)
def test_words_follow_word_boundaries(spark, given_text, words):
    assert one(spark, given_text, text.word_tokens) == words


def test_null_text_has_no_words(spark):
    assert one(spark, None, text.word_tokens) is None


def test_long_junk_does_not_exhaust_the_stack(spark):
    junk = "ab1" * 200_000 + " " + "1,2," * 100_000 + " " + "a.b." * 100_000
    words = one(spark, junk, text.word_tokens)
    assert [len(w) for w in words] == [600_000, 399_999, 399_999]


def test_trims_take_every_whitespace(spark):
    padded = "\n\t  Titel  \n"
    assert one(spark, padded, text.trim_left) == padded.lstrip()
    assert one(spark, padded, text.trim_both) == padded.strip() == "Titel"
    assert one(spark, "\x1c a\nb \x1f\n", text.trim_both) == "a\nb"


def test_regex_uses_unicode_word_rules(spark):
    search = lambda p: lambda c: text.matches(c, p)
    assert one(spark, "die ÖVP hat", search(r"\bÖVP\b"))
    assert not one(spark, "die XÖVP hat", search(r"\bÖVP\b"))
    assert not one(spark, "die ÖVPé hat", search(r"\bÖVP\b"))
    assert one(spark, None, search("x")) is False


fragments = st.sampled_from(
    ["ÖVP", "SPÖ", "xFPÖ", "FPÖ", "Grüne", "Grünen", "Die Grünen", "Österreichische Volkspartei", "OeNB", "OeNBs", "X-Aktien",
     "Aktie", "Rezessionen", "ATX", "ATXs", "Börse", "Börsen", "Sebastian Kurz", "Sebastian", "Kapitalmarkt", " ", "é", "."]
)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(fragments, max_size=5).map("".join), min_size=1, max_size=40))
def test_needles_never_change_a_match(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "x string")
    cases = [*presets.PARTY_PATTERNS.values(), presets.BANK_PATTERN, presets.PERSON_PATTERN, presets.MARKET_PATTERN, text.any_of(presets.PARTY_TERMS)]
    assert all(text.needles_of(p) for p in cases)
    column = F.col("x")
    differing = [text.matches(column, p) != F.coalesce(column.rlike("(?U)" + p), F.lit(False)) for p in cases]
    assert df.select(*[F.count_if(d) for d in differing]).first() == (0,) * len(cases)


def test_terms_with_regex_syntax_give_no_needles():
    assert text.plain_terms(["a", "b.c"]) == [] and text.plain_terms(["ÖVP", "b c"]) == ["ÖVP", "b c"]
    assert text.needles_of("") == text.needles_of("a|") == text.needles_of("a[bc]|d") == text.needles_of(r"a\d") == []
    assert text.needles_of(r"\ba\b|b c") == ["a", "b c"] and text.needles_of(r"(^|[^\pL\pN_])x($|[^\pL\pN_])|y") == ["x", "y"]


def test_term_list():
    assert re.search(text.any_of(["ÖVP", "Volkspartei"]), "die Volkspartei")


@pytest.mark.parametrize(
    "written, read",
    [
        ("2023-05-01T12:34", "2023-05-01 12:34:00"),
        ("2023-5-1T7:05", "2023-05-01 07:05:00"),
        ("2023-05-01T12:34:56", None),
        ("2023-05-01 12:34", None),
        ("2023-02-30T12:34", None),
        ("2023-05-01T24:34", None),
        ("", None),
        (None, None),
    ],
)
def test_article_time_is_strict(spark, written, read):
    value = one(spark, written, dates.article_time)
    assert (None if value is None else str(value)) == read


def test_week_starts_on_monday(spark):
    week = lambda c: dates.week(c.cast("date")).cast("string")
    assert one(spark, "2023-04-02", week) == "2023-03-27"
    assert one(spark, "2023-04-03", week) == "2023-04-03"


@pytest.mark.parametrize(
    "logits, label",
    [([0.0, 1.0, 0.5], 1), ([0.0, 0.5, 1.0], -1), ([2.0, 1.0, 0.5], 0), ([0.0, 1.0, 1.0], 1), ([1.0, 0.0, 1.0], -1),
     ([900.0, -900.0, 0.0], 0), (None, None)],
)
def test_label_of_most_probable_class(spark, logits, label):
    got = one(spark, logits, lambda c: scores.class_label(scores.softmax(c)), "array<float>")
    assert got == label


def test_label_mapping_is_a_parameter(spark):
    swapped = lambda c: scores.class_label(c, {0: 1.0, 1: -1.0})
    assert one(spark, [0.7, 0.2, 0.1], swapped, "array<double>") == 1
    assert one(spark, [0.2, 0.7, 0.1], swapped, "array<double>") == -1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-50, 50, width=32), min_size=3, max_size=3))
def test_softmax_sums_to_one(spark, logits):
    p = one(spark, logits, scores.softmax, "array<float>")
    assert sum(p) == pytest.approx(1.0) and all(x >= 0 for x in p)
