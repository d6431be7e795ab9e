"""What moves between tasks: texts rather than the rows of their words, copies for frequent keys alone, broadcasts within a bound."""

import re

from pyspark.sql import functions as F

from newsloom.operators import joins, sentiment


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffled_lexicon_score_does_not_move_words_by_article(spark):
    rows = [(1, "the cat the"), (1, "the dog"), (None, "dog"), (None, "dog"), (2, ""), (3, None)]
    articles = spark.createDataFrame(rows, "id long, body string")
    lexicon = spark.createDataFrame([("the", 0.5), ("dog", -1.0), ("dog", 0.25)], "word string, value double")
    scored = sentiment.lexicon_score_shuffled(articles, lexicon)
    assert sorted(map(tuple, scored.collect()), key=str) == [(1, 0.75), (2, 0.0), (3, 0.0), (None, -1.5)]
    dealt_by = re.findall(r"hashpartitioning\(([^)]*)\)", plan(sentiment.lexicon_score_shuffled(articles, lexicon)))
    assert dealt_by and not [keys for keys in dealt_by if "id#" in keys and "word#" in keys]


def test_spread_join_copies_frequent_keys_alone(spark):
    big = spark.createDataFrame([("hot", k) for k in range(50)] + [("cold", 50), (None, 51), ("none", 52)], "k string, v long")
    small = spark.createDataFrame([("hot", 1.0), ("cold", 2.0), ("other", 3.0), (None, 4.0)], "k string, w double")
    parts = joins.frequent(big, "k", rows=10)
    assert [tuple(r) for r in parts.collect()] == [("hot", 5)]
    for how in ("inner", "left"):
        made = joins.spread_join(big, small, parts, "k", F.col("v"), how)
        assert sorted(map(tuple, made.collect()), key=str) == sorted(map(tuple, big.join(small, "k", how).collect()), key=str)


def test_join_checked_holds_its_bound(spark):
    small = spark.range(100).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(joins.join_checked(big, small, "k"))
        assert "BroadcastHashJoin" not in plan(joins.join_checked(big, small, "k", max_bytes=1000))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
