"""Vector codes, conversation repair and the n-gram join on hand-made and random rows."""

import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import conversations, ngramjoin, registry, vectorcodes

VECTORS = "vec_id long, embedding array<double>, label int"
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


# vector codes


@pytest.mark.parametrize("spread", [3, 50, 4000])
def test_gnat_finds_the_first_nearest_entry(spread):
    rng = np.random.RandomState(spread)
    entries = rng.randint(-spread, spread, (256, 4))
    entries[100:120] = entries[5]  # equal entries
    queries = np.concatenate([rng.randint(-spread, spread, (2000, 4)), entries])
    away = ((queries[:, None, :] - entries[None]) ** 2).sum(2)
    tree = vectorcodes.Gnat(entries)
    index, best = tree.nearest(queries)
    assert (index == away.argmin(1)).all() and (best == away.min(1)).all()
    assert tree.compared < queries.shape[0] * 256


def test_gnat_leaves_subtrees_out():
    rng = np.random.RandomState(1)
    centres = rng.randint(-1000, 1000, (16, 8))
    entries = (centres[:, None, :] + rng.randint(-20, 20, (16, 16, 8))).reshape(-1, 8)
    queries = centres[rng.randint(0, 16, 3000)] + rng.randint(-20, 20, (3000, 8))
    tree = vectorcodes.Gnat(entries)
    index, _ = tree.nearest(queries)
    assert (index == ((queries[:, None, :] - entries[None]) ** 2).sum(2).argmin(1)).all()
    assert tree.compared < 0.25 * queries.shape[0] * 256


def test_gnat_is_exact_beyond_floats():
    most = vectorcodes.limit(4)
    entries = np.array([[most, most, most, most - 1 - (i * i) % 7] for i in range(40)])
    queries = np.array([[-most, -most, -most, most - 3], [most, most, most, most - 3]])
    index, best = vectorcodes.Gnat(entries).nearest(queries)
    for q, i, d in zip(queries.tolist(), index, best, strict=True):
        away = [sum((a - b) ** 2 for a, b in zip(q, e, strict=True)) for e in entries.tolist()]
        assert d == min(away) and i == away.index(min(away))


def coded(spark, rows, schema=VECTORS, **named):
    found, books = vectorcodes.compress(spark.createDataFrame(rows, schema), **named)
    summed = vectorcodes.with_label_error(found).collect()
    return {r["_id"]: ("".join(f"{c:02x}" for c in r["codes"]), r["error"], r["label_error"]) for r in summed}, books, summed


def test_vector_codes_against_brute_force_with_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(700)]
    rows += [(i, rows[0][1], None) for i in range(700, 720)]
    odd = [(-5, None, 1), (-4, [None] * 8, 1), (-3, [float("nan")] * 8, 1), (-2, [1.0] * 7 + [float("inf")], 2), (-1, [], 2), (900, [1.0] * 4, 1), (901, [1.0] * 6, 1)]
    got, books, _ = coded(spark, rows + odd)
    want, digest = brute.vector_codes(rows)
    assert got == want and vectorcodes.digest(books) == digest


def test_vector_codes_of_few_repeated_and_nameless_rows(spark):
    v, w = [0.5] * 4, [-0.5] * 4
    got, books, rows = coded(spark, [(None, [9.0] * 4, 1), (2, w, 1), (1, v, 1), (1, v, 1)])
    assert [b.tolist() for b in books] == [[[512], [512], [-512], [9216]]] * 4
    assert sorted((r["_id"] or 0, r["codes"]) for r in rows) == [(0, [3] * 4), (1, [0] * 4), (1, [0] * 4), (2, [2] * 4)]
    assert coded(spark, [])[0] == {} and vectorcodes.digest([])


def test_vector_codes_of_huge_components_and_clashing_names(spark):
    rows = [(1, [1e300] * 4, 1, 5), (2, [-1e300] * 4, 1, 5)]
    got, books, _ = coded(spark, rows, "error long, codes array<double>, _key int, part int", id_col="error", vector="codes", label="_key")
    most = vectorcodes.limit(4)
    assert [b.tolist() for b in books] == [[[most], [-most]]] * 4 and {v[1] for v in got.values()} == {0}


# conversations


def repaired(spark, rows):
    df = spark.createDataFrame(rows, TURNS)
    return {r["conv_id"]: tuple(r)[1:] for r in conversations.summary(conversations.damage(df), df).collect()}


def test_block_weights_agree_with_trying_everything():
    for initials in itertools.product("suax", repeat=3):
        for faults in itertools.product((1, 2, 3), repeat=3):
            codes = "".join(chr(65 + f * 4 + "suax".index(i)) for f, i in zip(faults, initials, strict=True))
            costs, ranks, letters = conversations.block_weights(codes)
            ends = [(costs[e] + 2 * len(t), letters[e] + t) for e, t in enumerate(conversations.TAIL) if costs[e] != conversations.NONE]
            want = brute.cheapest(tuple((i, f == 1, int(f == 2)) for f, i in zip(faults, initials, strict=True)))
            assert min(ends) == want


def test_random_conversations_over_many_blocks(spark, monkeypatch):
    rng = random.Random(11)
    texts = ["Well.", "Who?", "no end", " ", "", "Yes!\n", "a.b", ". x", "Well."]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(150)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice([*texts, None])) for _ in range(600)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for c in range(10, 40) for t in range(8)]
    monkeypatch.setattr(conversations, "BLOCK", 16)
    assert repaired(spark, rows) == brute.conversations(rows)


def test_conversation_of_one_long_run(spark, monkeypatch):
    monkeypatch.setattr(conversations, "BLOCK", 64)
    rows = [(7, t, ("user", "assistant", "user", "tool")[t % 4], f"Turn {t}.") for t in range(700)] + [(8, 5, "user", "Same.")] * 300
    assert repaired(spark, rows) == brute.conversations(rows)


def test_conversations_without_rows(spark):
    gone = next(i for i in range(1000) if brute.damaged([(i, 0, "user", "x")]) == [])
    assert repaired(spark, [(gone, 0, "user", "x")])[gone] == (0, 0, 0, 0, 0, 0, "", brute.hashlib.sha256(b"").hexdigest())
    assert repaired(spark, []) == {}


def test_edit_script_and_extra_columns(spark):
    rows = [(1, 0, "system", "Be kind.", 1), (1, 1, "assistant", "Hi.", 1), (1, 2, "user", "", 1), (1, 3, "user", "why", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, _k int")
    got = sorted((r["at"], r["edit"], r["fault"], r["turn"], r["role"], r["text"]) for r in conversations.edits(df).collect())
    # KIKDD, KIKDKI and KRDR cost 8 each; the first comes first in ASCII
    assert got == [
        (0, "K", "none", 0, "system", "Be kind."), (1, "I", None, None, "user", ""), (2, "K", "none", 1, "assistant", "Hi."),
        (3, "D", "blank", 2, None, None), (4, "D", "truncated", 3, None, None),
    ]


# n-gram join


def components(spark, rows, schema=DOCS, **named):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.joined(spark.createDataFrame(rows, schema), **named).collect()}


def edited(words, rng, share):
    return " ".join(rng.choice(["red", "blue", "green", "x%d" % rng.randint(0, 999)]) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("slots", [1, 64, 1 << 20])
def test_join_against_all_pairs(spark, monkeypatch, slots):
    rng = random.Random(5)
    monkeypatch.setattr(ngramjoin, "SLOTS", slots)
    monkeypatch.setattr(ngramjoin, "AT_ONCE", 50)
    monkeypatch.setattr(ngramjoin, "CHUNK", 5)
    monkeypatch.setattr(ngramjoin, "BLOCK", 2000)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for g in range(6):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([8, 60, 200]))]
        base += passage if g % 2 else []
        texts += [edited(base, rng, rng.choice([0, 0.004, 0.01, 0.03, 0.1])) for _ in range(30)]
    texts += [" ".join(passage[: rng.randint(1, 40)]) for _ in range(30)] + ["", None, "one", "One", "one two", " ", " "]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert components(spark, rows) == brute.near_components(rows, 90, 3)


def test_join_by_other_shares_and_widths(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 500)}" for _ in range(80)]
    rows = list(enumerate(edited(base, rng, rng.choice([0, 0.02, 0.05, 0.1])) for _ in range(60)))
    for percent, width in ((60, 2), (100, 3), (97, 5)):
        assert components(spark, rows, percent=percent, width=width) == brute.near_components(rows, percent, width)


def test_join_at_the_threshold(spark):
    words = [f"w{i}" for i in range(21)]  # 19 shingles; one word more at the end: 20, of which 19 are common
    rows = [(1, " ".join(words)), (2, " ".join([*words, "z"])), (3, " ".join([*words, "y", "x"])), (4, " ".join([*words, "y", "v", "u"]))]
    assert components(spark, rows) == brute.near_components(rows, 90, 3)


def test_join_of_nameless_repeated_and_clashing_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1), (5, text, 2), (5, "other words here", 3), (None, "alone in this", 4), (9, text + " end", 5), (9, text + " end", 5)]
    schema = "doc_id long, text string, node int"
    got = ngramjoin.joined(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == [
        ("5", 1, "5"), ("5", 28, "5"), ("9", 29, "5"), ("9", 29, "5"), ("None", 1, "None"), ("None", 28, "5")
    ]
    assert components(spark, []) == {}


def test_last_round_holds_bounded_blocks(spark, monkeypatch):
    """Texts that share a passage and are not alike: every group of the last round stays within two blocks."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))) for i in range(400)]
    monkeypatch.setattr(ngramjoin, "SLOTS", 1)
    monkeypatch.setattr(ngramjoin, "BLOCK", 3000)
    seen = []
    plain = ngramjoin.by_group

    def watched(frame, keys, of_groups):
        if len(keys) > 2:
            seen.append(frame.groupBy(*keys).agg(F.sum("n").alias("s")).agg(F.max("s")).first()[0])
        return plain(frame, keys, of_groups)

    monkeypatch.setattr(ngramjoin, "by_group", watched)
    assert {c for _, c in components(spark, rows).values()} == set(range(400))
    assert seen and all(s is None or s < 4 * 3000 for s in seen)


def test_registered_names():
    assert {"op11_gnat_codes", "op12_cheapest_edits", "op13_prefix_join"} <= set(registry.queries())
