"""The registered queries over the smallest tables, against plain re-statements."""

import base64
import collections
import hashlib
import html
import math
import os
import re
import struct
import zlib

import brute
import duckdb
import public_tokenizers
import pytest
import tiktoken

from newsloom.llm import registry


@pytest.fixture(scope="module")
def rows_of(sf_dir):
    def read(name, columns):
        return duckdb.sql(f"select {columns} from '{os.path.join(sf_dir, name)}.parquet'").fetchall()

    return read


@pytest.fixture(scope="module")
def docs(rows_of):
    return rows_of("documents", "doc_id, text")


def run(spark, sf_dir, name):
    return registry.queries()[name](spark, sf_dir).collect()


def test_names_and_order():
    names = list(registry.queries())
    assert [n for n in names if n == "pipeline"] and sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names if n != "pipeline") == list(range(1, 14))


def test_op1(spark, sf_dir, rows_of):
    got = collections.defaultdict(list)
    for r in run(spark, sf_dir, "op1_norm_buckets"):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {q: sorted(v) for q, v in got.items()} == brute.top_k(rows_of("embeddings", "vec_id, embedding"))


def test_op2(spark, sf_dir, docs):
    texts = dict(docs)
    found = run(spark, sf_dir, "op2_compression_bands")
    assert len(found) == len(docs)
    for r in found:
        assert tuple(r)[1:7] == brute.quality(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_op2_keeps_good_and_drops_repetitive(spark, sf_dir, docs):
    texts = dict(docs)
    found = {r["doc_id"]: r for r in run(spark, sf_dir, "op2_compression_bands")}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf_dir}/labels.parquet'").fetchall())
    good = [found[i] for i, q in labels.items() if q and not found[i]["base_failed"]]
    assert all(r["kept"] for r in good)
    assert all(not r["kept"] for i, r in found.items() if len(texts[i].encode()) > 4 * r["n_words"] and r["ratio"] > 8)


def test_op3(spark, sf_dir, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(docs)
    for r in run(spark, sf_dir, "op3_prefix_bpe"):
        text = texts[r["doc_id"]] or ""
        ids = own.encode_ordinary(text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op4(spark, sf_dir, docs):
    counts = collections.Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(w.encode() for w in brute.WORD.findall(brute.lowered(t)))
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    texts, base, model, tokens = dict(docs), 0.0, 0.0, 0
    for r in run(spark, sf_dir, "op4_hashed_maxent"):
        found = [w.encode() for w in brute.WORD.findall(brute.lowered(texts[r["doc_id"]]))] + [b""]
        want = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in found)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(found), sum(counts[w] > 0 for w in found), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) and math.isfinite(r["score"])
        if r["held_out"]:
            base, model, tokens = base + r["base_score"], model + r["score"], tokens + r["n_tokens"]
    assert model > base  # contexts help on texts the model has not seen


def test_op5(spark, sf_dir, rows_of):
    pages = rows_of("pages", "page_id, html")
    first = {}
    for i, page in sorted(pages):
        first.setdefault(page or "", i)
    want = {}
    for i, page in pages:
        data = (page or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        again = first[page or ""] != i
        want[i] = (len(data), digest, "revisit" if again else "response", first[page or ""] if again else None)
    assert {r["page_id"]: tuple(r)[1:] for r in run(spark, sf_dir, "op5_warc")} == want


def test_op6(spark, sf_dir, docs):
    texts = dict(docs)
    for r in run(spark, sf_dir, "op6_primed_novelty"):
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.base_secrets(texts[r["doc_id"]])


def test_op7(spark, sf_dir, rows_of):
    sizes, of_source = {}, collections.Counter()
    for i, text, source in rows_of("documents", "doc_id, text, source"):
        sizes[i] = (len(brute.WORD.findall(text or "")), source)
        of_source[source] += sizes[i][0]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(of_source))}
    target, free, left = {}, set(of_source), 1.5 * sum(of_source.values())
    while True:
        rate = left / sum(weights[s] for s in free)
        full = {s for s in free if rate * weights[s] > 2 * of_source[s]}
        if not full:
            break
        target |= {s: 2.0 * of_source[s] for s in full}
        left, free = left - sum(target[s] for s in full), free - full
    target |= {s: rate * weights[s] for s in free}
    found = run(spark, sf_dir, "op7_hash_mix")
    taken = collections.Counter()
    for r in found:
        size, source = sizes[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, of_source[source]) and r["taken"] <= 2 * size
        assert math.isclose(r["target"], target[source], rel_tol=1e-9)
        taken[source] += r["taken"]
    for s in of_source:
        assert abs(taken[s] - target[s]) <= max(n for n, at in sizes.values() if at == s) / 2 + 1
    assert found == run(spark, sf_dir, "op7_hash_mix")


def test_op8(spark, sf_dir, rows_of):
    want = {}
    for i, url, page in rows_of("pages", "page_id, url, html"):
        article = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1|h2|ul|li)(?:\s[^>]*)?>", re.sub(r"</?b>|<!--.*?-->", "", article).replace("<br>", " "))
        text = "\n\n".join(p for p in (" ".join(html.unescape(x).split()) for x in parts) if p)
        want[i] = (url, text, len(text))
    assert {r["page_id"]: tuple(r)[1:] for r in run(spark, sf_dir, "op8_template_classes")} == want


def test_op9(spark, sf_dir):
    found = {r["doc_id"]: r for r in run(spark, sf_dir, "op9_ordinal_toxicity")}
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{sf_dir}/labels.parquet'").fetchall())
    right = sum(found[i]["toxic"] == bool(x) for i, x in labels.items())
    assert right > 0.9 * len(labels)
    assert all(0 <= r["expected_severity"] <= 2 and r["p_severe"] <= r["p_toxic"] for r in found.values())


def test_op10(spark, sf_dir, docs):
    want = brute.near_components(docs)
    got = run(spark, sf_dir, "op10_hyper_minhash")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "encoding"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == columns
        after = [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()]
        if name == "near_duplicates":
            assert {i for i, _, _ in after} == {i for i, (_, c) in brute.near_components(before.items()).items() if i == c}
        if name == "secrets":
            assert {i for i, _, _ in after} == set(before)
            assert all(brute.base_secrets(t)[:3] == (0, 0, 0) and n == len(t) for _, t, n in after)
    tokens = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert tokens.count() == kept.count() and min(r["n_tokens"] for r in tokens.collect()) > 0


def test_op11(spark, sf_dir, rows_of):
    want, digest = brute.vector_codes(rows_of("embeddings", "vec_id, embedding, label"))
    got = {r["vec_id"]: tuple(r)[1:] for r in run(spark, sf_dir, "op11_gnat_codes")}
    assert got == {i: (*v, digest) for i, v in want.items()}


def test_op12(spark, sf_dir, rows_of):
    got = {r["conv_id"]: tuple(r)[1:] for r in run(spark, sf_dir, "op12_cheapest_edits")}
    assert got == brute.conversations(rows_of("conversations", "conv_id, turn, role, text"))


def test_op13(spark, sf_dir, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, sf_dir, "op13_prefix_join")}
    assert got == brute.near_components(docs, 90, 3)
