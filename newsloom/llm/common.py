"""What the operators share: words, table reading, columns of structs."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import newsloom

# A word is a run of characters other than the six ASCII white space characters.  On UTF-8 bytes,
# bytes.split() cuts at exactly these characters, and bytes.lower() lowers exactly A-Z.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; none for null."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As ``words``, with A-Z lowered."""
    return text.encode().lower().split() if text else []


def word_count(text: str) -> F.Column:
    """Number of words of a text column, on the JVM; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def unpacked(df: DataFrame, struct: str, *fields: str) -> DataFrame:
    """The named fields of a struct column in its place; ``old as new`` renames."""
    kept = [F.col(f"`{c}`") for c in df.columns if c != struct]
    named = [f.split(" as ") for f in fields]
    return df.select(*kept, *[F.col(struct)[n[0]].alias(n[-1]) for n in named])


def ready_for_python(df: DataFrame, rows: int = 1000, size: str = "16m") -> DataFrame:
    """``df``, in a session whose Python workers can import this package and get small batches.

    Workers hold a batch and its results, so the session's bounds on batches are lowered.
    """
    spark = df.sparkSession
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, rows + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once an application: they need not have it installed, wherever the
    driver was started."""
    context = spark.sparkContext
    if context.applicationId in _shipped_to:
        return
    root = pathlib.Path(newsloom.__file__).parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="newsloom-")) / f"newsloom-{context.applicationId}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))  # served by the driver
    _shipped_to.add(context.applicationId)


_shipped_to: set[str] = set()
