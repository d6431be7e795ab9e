"""The operators' queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, conversations, html, lm, minhash, mixing, ngramjoin, quality, secrets, topk, toxicity, vectorcodes, warc
from newsloom.llm.common import table
from newsloom.session import shared_path, written_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN, packed=True)
    decoded = bpe.decode(encoded.drop("text"), VOCABULARY)
    return decoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, revisits by their headers alone."""
    path = shared_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    payload = F.coalesce("payload", F.lit(b""))
    full = warc.read_warc(spark, path, "page_id long, record_type string, refers_to long, payload_digest string, payload binary")
    full = full.filter(F.col("record_type") == "response").select(
        "page_id", F.octet_length(payload).cast("long").alias("payload_bytes"),
        warc.digest_of(payload).alias("payload_digest"), "record_type", "refers_to",
    )
    heads = warc.read_warc(
        spark, path, "page_id long, payload_length long, payload_digest string, record_type string, refers_to long"
    ).filter(F.col("record_type") == "revisit")
    bare = F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest")
    return full.unionByName(
        heads.select("page_id", F.col("payload_length").alias("payload_bytes"), bare, "record_type", "refers_to")
    )


def op6_primed_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_novel")


def op7_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def op8_template_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = html.extract(table(spark, sf_dir, "pages"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity (0 to 2) and verdict of every document, learned from the labels."""
    graded = toxicity.grade(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return graded.drop("text")


def op10_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_gnat_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    summed = vectorcodes.with_label_error(written_table(coded, "codes"))
    code = F.lower(F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0"))))
    return summed.select(
        F.col("_id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(vectorcodes.digest(books)).alias("codebooks_sha256")
    )


def op12_cheapest_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversations.summary(conversations.damage(turns), turns)


def op13_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.joined(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # uses this package in turn

    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL states none of these in full; the tests compare them with brute force."""
    return {}
