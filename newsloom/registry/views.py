"""The library's tables, derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.extract import extract_links
from newsloom.session import written_table
from newsloom.sources.tables import spread

# The lexicon of the checks (a repeated word, and a capitalised one that never matches).
LEXICON_SQL = """
select word, cast(value as double) as value
from (values ('the',0.004),('of',-0.02),('and',0.0312),('und',0.1),('und',-0.03),('der',-0.0048),
             ('mit',0.2),('les',0.05),('para',-0.11),('Der',9.0)) as t(word, value)
"""


# Given columns used here; a stated schema saves the job that would infer it.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "orders": "o_orderdate timestamp_ntz, o_totalprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, value double",
    "embeddings": "vec_id bigint, embedding array<float>",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The small given tables are single files with one row group; tables of several files stay as they are."""
    return spread(df, key, df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split_part("text", F.lit("\n"), F.lit(1)), F.split_part("text", F.lit("\n"), F.lit(2))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("/story/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("kicker"),
        lines[0].alias("title"),
        lines[1].alias("subtitle"),
        F.when(F.col("doc_id") % 17 == 0, "")
        .otherwise(F.concat("lang", F.lit("-"), (F.col("doc_id") % 17).cast("string")))
        .alias("origins"),
        F.expr("date_add(date'1995-01-02', cast(doc_id * 7 % 400 as int))").alias("pubdate"),
        F.col("text").alias("body"),
    )


def wide_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows; those of a single file are dealt over the cores for text work."""
    return dealt(articles(spark, sf_dir), "id")


def scored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with a sentiment for the labelled ones, null for the rest."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("sentiment")
    )
    return articles(spark, sf_dir).join(labels, "id", "left")


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.sql(LEXICON_SQL)


def derived_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger lexicon: the words of the benchmark passages, valued by how often they occur."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\pL\pN]+"), F.lit(0))).alias("word")
    )
    return words.groupBy("word").agg((F.count(F.lit(1)) * F.lit(0.25)).cast("double").alias("value"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest order value per working day."""
    date = F.to_date("o_orderdate")
    return (
        table(spark, sf_dir, "orders")
        .filter(F.weekday(date) < 5)
        .groupBy(date.alias("date"))
        .agg(F.max("o_totalprice").alias("close"))
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_url, url: the link of every list item of every page."""
    source = pages(spark, sf_dir).withColumnRenamed("url", "page_url")
    return extract_links(dealt(source, "page_id"), "li", keep=("page_url",))


def stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all pages, extracted once."""
    return written_table(page_links(spark, sf_dir), "links")


def frontier(spark: SparkSession, sf_dir: str, links: DataFrame | None = None) -> DataFrame:
    """Page addresses (absolute, to do) and their links (relative; done if found over plain http)."""
    own = pages(spark, sf_dir).select(
        "url", F.lit("2024-02-01").cast("date").alias("datum"), F.lit(0).alias("downloaded")
    )
    found = (page_links(spark, sf_dir) if links is None else links).select(
        "url",
        F.lit("2024-02-02").cast("date").alias("datum"),
        F.col("page_url").startswith("http://").cast("int").alias("downloaded"),
    )
    return own.unionByName(found)


def collected(links: DataFrame) -> DataFrame:
    """Addresses that already have an article: the links found over plain http."""
    return links.filter(F.col("page_url").startswith("http://")).select("url")


def link_outcomes(links: DataFrame) -> DataFrame:
    """One outcome per address found over https; the long ones failed."""
    tried = links.filter(F.col("page_url").startswith("https://"))
    return tried.select("url").distinct().select("url", (F.length("url") > 6).alias("failed"))


def article_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, html: one article page per row of the article view.

    Without a subtitle its element is missing; without an author so is that one; Spanish articles
    carry seconds in their time.
    """

    def escaped(column: str):
        text = F.replace(F.col(column), F.lit("&"), F.lit("&amp;"))
        text = F.replace(text, F.lit("<"), F.lit("&lt;"))
        return F.replace(text, F.lit(">"), F.lit("&gt;"))

    base = articles(spark, sf_dir).withColumn("spanish", F.startswith("origins", F.lit("es-")))
    time = F.concat(
        F.date_format("pubdate", "yyyy-MM-dd"),
        F.when(F.col("spanish"), "T08:30:15").otherwise("T08:30"),
    )
    html = F.concat(
        F.lit("<html><body><article class='story main'><p class='lead article-kicker'>\n  "),
        escaped("kicker"),
        F.lit("</p><h1 class=article-title> "),
        escaped("title"),
        F.lit("</h1>"),
        F.when(F.col("subtitle") == "", "").otherwise(
            F.concat(F.lit("<p class='article-subtitle'>"), escaped("subtitle"), F.lit("</p>"))
        ),
        F.when(F.col("origins") == "", "").otherwise(
            F.concat(F.lit("<div class='article-origins'> <b>"), escaped("origins"), F.lit("</b> </div>"))
        ),
        F.lit("<time datetime=' "),
        time,
        F.lit(" '>x</time><!-- note --><div class='article-body'><div> "),
        escaped("body"),
        F.lit("<br></div> \n</div></article><div class='article-body'>second</div></body></html>"),
    )
    return base.select("id", "url", html.alias("html"))
