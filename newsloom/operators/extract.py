"""From stored pages to links and article fields."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions import markup
from newsloom.functions.dates import article_time
from newsloom.functions.text import trim_both, trim_left
from newsloom.session import small_batches

# Workers get the helper with the function itself, wherever the driver was started.
cloudpickle.register_pickle_by_value(markup)


@dataclass(frozen=True)
class Field:
    """One article field: where it is on the page and how it is cleaned."""

    name: str
    selector: str
    attr: str | None = None
    trim: str = "left"  # "left" or "both"
    required: bool = True
    time: bool = False


# The article layout.
ARTICLE_FIELDS = (
    Field("kicker", ".article-kicker"),
    Field("title", ".article-title"),
    Field("subtitle", ".article-subtitle"),
    Field("origins", ".article-origins", trim="both", required=False),
    Field("pubdate", "time", attr="datetime", trim="both", time=True),
    Field("body", ".article-body", trim="both"),
)


def extract_links(pages: DataFrame, container: str = "article", keep: Sequence[str] = ()) -> DataFrame:
    """One row per container that holds a link: the address of its first link."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def links(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(lambda page: markup.first_links(page, container))

    found = small_batches(pages).select(*keep, links.asNondeterministic()("html").alias("_links"))
    return found.select(*keep, F.explode("_links").alias("url"))


def page_fields(pages: DataFrame, fields: Sequence[Field] = ARTICLE_FIELDS) -> DataFrame:
    """Every field of every page as cleaned text (null if not found), next to the page's columns."""
    wanted = [(f.selector, f.attr) for f in fields]
    names = [f.name for f in fields]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])

    @F.pandas_udf(schema)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for html in batches:
            rows = [markup.first_elements(page, wanted) for page in html]
            yield pd.DataFrame(rows, columns=names, dtype="object")

    rest = [c for c in pages.columns if c != "html"]
    # marked so that a filter on the fields stays above the parse instead of repeating it
    parsed = small_batches(pages).select(*rest, read.asNondeterministic()("html").alias("_fields"))
    return parsed.select(
        *rest,
        *[
            (trim_both if f.trim == "both" else trim_left)(F.col("_fields")[f.name]).alias(f.name)
            for f in fields
        ],
    )


def read_articles(pages: DataFrame, fields: Sequence[Field] = ARTICLE_FIELDS) -> DataFrame:
    """Page fields with times parsed, absent optional text as "" and a flag ``ok``."""
    found = page_fields(pages, fields)
    for f in fields:
        if f.time:
            found = found.withColumn(f.name, article_time(F.col(f.name)))
        elif not f.required:
            found = found.withColumn(f.name, F.coalesce(F.col(f.name), F.lit("")))
    ok = F.lit(True)
    for f in fields:
        if f.required:
            ok = ok & F.col(f.name).isNotNull()
    return found.withColumn("ok", ok)


def accepted(read: DataFrame) -> DataFrame:
    return read.filter("ok").drop("ok")


def rejected(read: DataFrame, key: str = "url") -> DataFrame:
    """Keys of the pages that lack a required field or carry a bad time."""
    return read.filter(~F.col("ok")).select(key)
