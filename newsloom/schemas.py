"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T

ARTICLES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("kicker", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("subtitle", T.StringType()),
        T.StructField("origins", T.StringType()),
        T.StructField("pubdate", T.TimestampNTZType()),
        T.StructField("body", T.StringType()),
    ]
)

FRONTIER = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("datum", T.DateType()),
        T.StructField("downloaded", T.IntegerType()),
    ]
)

LEXICON = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("value", T.DoubleType())]
)

PRICES = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("close", T.DoubleType())]
)

PAGES = T.StructType([T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
