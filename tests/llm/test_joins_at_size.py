"""What keeps the joins' work in proportion: filters that hold for long texts, pairs named once, rows moved once."""

import numpy as np

from newsloom.llm import minhash, ngramjoin


def rows_of(sets):
    sigs = [ngramjoin.parities(h) for h in sets]
    return {
        "n": np.array([len(h) for h in sets]), "pos": np.zeros(len(sets), np.int64), "label": np.arange(len(sets)),
        "node": np.arange(len(sets)), "size": np.array([len(x) for x in sigs]), "sig": ngramjoin.by_size(sigs),
    }


def passed(sets):
    ends = np.full(len(sets), len(sets))
    left, right, bound = ngramjoin.passing(rows_of(sets), ends, 90, lambda i, j: np.ones(len(i), bool))
    return {(int(i), int(j)): int(b) for i, j, b in zip(left, right, bound, strict=True)}


def test_unlike_sets_of_any_size_do_not_reach_verification():
    rng = np.random.RandomState(7)
    for n in (40, 400, 1030, 6000):
        whole = rng.randint(0, 1 << 62, 2 * n, np.int64).astype(np.uint64) * np.uint64(3)
        near, far = whole[n // 5 : n // 5 + n], whole[n : 2 * n]  # two thirds in common, nothing in common
        assert passed([np.sort(x) for x in (whole[:n], near, far)]) == {}


def test_the_filter_never_loses_a_pair_that_is_alike():
    rng = np.random.RandomState(8)
    for n in (3, 100, 1030, 2100, 4200, 9000):  # also on both sides of a step of size
        whole = np.unique(rng.randint(0, 1 << 62, n, np.int64).astype(np.uint64) * np.uint64(3))
        sets = [whole, whole[: -(-len(whole) * 9 // 10)], whole[len(whole) // 10 :], whole[::-1][: len(whole) - len(whole) // 20][::-1]]
        found = passed(sets)
        for i, x in enumerate(sets):
            for j in range(i + 1, len(sets)):
                common = len(np.intersect1d(x, sets[j]))
                if 100 * common >= 90 * (len(x) + len(sets[j]) - common):
                    assert found[i, j] >= common


def test_a_round_that_hardly_joins_is_followed_by_the_last(spark, monkeypatch):
    rng = np.random.RandomState(9)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(40):
        base = [words[x] for x in rng.randint(0, 400, 120)]
        for m in range(5):
            some = list(base)
            some[int(rng.randint(0, 120))] = f"x{m}"
            rows.append((5 * k + m, " ".join(some)))
    turns, plain = [], ngramjoin.promising
    monkeypatch.setattr(ngramjoin, "promising", lambda *given: turns.append(given[1]) or plain(*given))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5 * k + m: (118, 5 * k) for k in range(40) for m in range(5)}
    assert turns in ([0], [0, 1])


def test_rows_are_dealt_out_by_bucket_once(spark):
    rows = [(1, [5, 6, 7]), (2, [5, 6, 8]), (3, [9, 6, 7]), (4, [1, 2, 3])]
    reps = spark.createDataFrame(rows, "node long, regs array<long>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = minhash.in_buckets(reps)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    wide = [x for x in plan.splitlines() if "+- Exchange hashpartitioning(band" in x and "REPARTITION_BY_COL" in x]
    assert len(wide) == 1 and plan.count("ReusedExchange") == 1
    got = sorted(tuple(r) for r in minhash.in_buckets(reps).select("band", "key", "node", "m", "pivot").collect())
    assert got == [(0, 5, 1, 2, 1), (0, 5, 2, 2, 1), (1, 6, 1, 3, 1), (1, 6, 2, 3, 1), (1, 6, 3, 3, 1), (2, 7, 1, 2, 1), (2, 7, 3, 2, 1)]


def test_ngrams_whose_pairs_are_all_settled_are_not_looked_at_again(spark, monkeypatch):
    rng = np.random.RandomState(10)
    rows = []
    for k in range(10):  # two texts share a passage and are not alike
        passage = [f"p{k}x{x}" for x in range(60)]
        rows += [(2 * k + m, " ".join(passage + [f"w{x}" for x in rng.randint(0, 10**6, 60)])) for m in range(2)]
    monkeypatch.setattr(ngramjoin, "SLOTS", 1)
    first, last, plain, rest = [], [], ngramjoin.promising, ngramjoin.remaining
    monkeypatch.setattr(ngramjoin, "promising", lambda *given: first.append(given[0].count()) or plain(*given))
    monkeypatch.setattr(ngramjoin, "remaining", lambda *given: last.append(given[0].count()) or rest(*given))
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(20)}
    assert first[0] > 0 and last == [0]
