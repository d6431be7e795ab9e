"""Incremental collection and scoring over folders of Parquet files.

The batch operators decide what is new by comparing tables; here Spark remembers which input
files it has read.  Each run handles what has arrived since the last one and stops.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import schemas
from newsloom.functions.scores import class_label, softmax
from newsloom.operators import extract, scoring


def _run(rows: DataFrame, out: str, state: str, split_by: Sequence[str] = ()) -> StreamingQuery:
    sink = (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    return (sink.partitionBy(*split_by) if split_by else sink).start()


def extract_new_pages(
    spark: SparkSession,
    pages: str,
    out: str,
    state: str,
    fields: Sequence[extract.Field] = extract.ARTICLE_FIELDS,
) -> StreamingQuery:
    """Read new page files once; articles land in ``ok=true``, rejected pages in ``ok=false``."""
    arrived = spark.readStream.schema(schemas.PAGES).parquet(pages)
    return _run(extract.read_articles(arrived, fields), out, state, ["ok"])


def score_new_articles(
    spark: SparkSession, articles: str, out: str, state: str, load: Callable[[], scoring.Scorer]
) -> StreamingQuery:
    """Model labels (id, sentiment) for new article files."""
    arrived = spark.readStream.schema(schemas.ARTICLES).parquet(articles).select("id", "body")
    scored = scoring.logits_of(arrived, load)
    return _run(
        scored.select("id", class_label(softmax(F.col("logits"))).alias("sentiment")), out, state
    )
