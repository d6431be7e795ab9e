"""Words that share a symbol are told apart by the words before them."""

import itertools

import numpy as np
import pytest

from newsloom.llm import lm, wordtree

RARE = [f"{a}{b}{c}xy" for a, b, c in itertools.product("bdgkm", "aeiou", "lnrst")]  # one ending, so one symbol


def texts(pairs, n):
    """Frequent words, then pairs of rarer words of one ending that only come in this order."""
    common = " ".join(f"c{k} c{k}" for k in range(250))
    made = np.random.default_rng(7)
    rows = [(k, common) for k in range(6)]
    for k in range(n):
        chosen = [pairs[i] for i in made.integers(0, len(pairs), 12)]
        rows.append((100 + k, " ".join(f"{a} {b}" for a, b in chosen)))
    return rows


def held_out_ids(spark, n):
    ids = spark.range(10**6, 10**6 + 40 * n).filter(~lm.training("id")).limit(n).collect()
    return [r["id"] for r in ids]


def scores(spark, rows):
    return {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


@pytest.mark.parametrize("part", [None, 100])
def test_order_of_rarer_words_of_one_ending_counts(spark, monkeypatch, part):
    if part:  # the symbol is dealt out to several tasks
        monkeypatch.setattr(lm, "SHARD_TOKENS", part)
        monkeypatch.setattr(lm, "PARTITION_TOKENS", part)
        monkeypatch.setattr(lm, "WINDOW", 500)
    pairs = list(zip(RARE[0::2], RARE[1::2]))
    right, wrong = held_out_ids(spark, 2)
    ab = [pairs[k] for k in (3, 17, 40, 41, 8, 25)]
    straight, swapped = " ".join(f"{a} {b}" for a, b in ab), " ".join(f"{b} {a}" for a, b in ab)
    found = scores(spark, [*texts(pairs, 150), (right, straight), (wrong, swapped)])
    assert found[right]["held_out"] and found[wrong]["held_out"]
    assert found[right]["base_score"] == pytest.approx(found[wrong]["base_score"], rel=1e-12)
    assert found[right]["score"] > found[wrong]["score"] + 3


def test_a_frequent_word_sees_the_rarer_word_before_it(spark):
    made = np.random.default_rng(3)
    rows = texts([(RARE[0], RARE[1])], 0)
    for k in range(400):
        rows.append((100 + k, " ".join(f"{RARE[i]} {'c1' if i % 2 else 'c2'}" for i in made.integers(0, 60, 20))))
    right, wrong = held_out_ids(spark, 2)
    both = [(right, f"{RARE[7]} c1"), (wrong, f"{RARE[7]} c2")]
    found = scores(spark, rows + both)
    gap = [found[i]["score"] - found[i]["base_score"] for i in (right, wrong)]
    assert gap[0] > gap[1] + 0.05


def test_probabilities_of_a_vocabulary_sum_to_one():
    made = np.random.default_rng(1)
    n, v = 3000, 37
    word = np.minimum(made.geometric(0.1, n) - 1, v - 1).astype(np.uint32)
    word[:v] = np.arange(v)
    one, two = (made.integers(0, 9, n) + word % 3).astype(np.uint32), made.integers(0, 6, n).astype(np.uint32)
    for a, b in ((3, 2), (0, 5), (99, 4), (2, 99), (99, 99)):  # 99 never comes
        probe = np.arange(v, dtype=np.uint32)
        train = np.arange(n + v) < n
        gain = wordtree.gains_of_words(
            np.append(word, probe), np.append(one, np.full(v, a, np.uint32)), np.append(two, np.full(v, b, np.uint32)), train
        )
        share = np.bincount(word, minlength=v) + 0.5
        p = share / share.sum() * 10 ** gain[n:]
        assert p.sum() == pytest.approx(1, abs=1e-4)
        assert np.allclose(gain[n:], 0) == (a == b == 99)
    assert gain[:n].mean() > 0


def test_tree_has_a_leaf_for_each_word():
    mass = np.array([50.5, 9.5, 9.5, 3.5, 1.5, 1.5, 1.5])
    codes, p = [""] * len(mass), np.ones(len(mass))
    for nodes in wordtree.levels(mass):
        for lo, mid, hi, share in zip(*nodes):
            for w in range(lo, hi):
                codes[w] += str(int(w >= mid))
                p[w] *= share if w >= mid else 1 - share
    assert len(set(codes)) == len(mass) and len(codes[0]) == 1
    assert np.allclose(p, mass / mass.sum())


def test_packed_columns_come_back():
    a, b = np.array([0, 5, 2**32 - 1], np.uint32), np.array([7, 7, 1 << 20], np.uint32)
    assert np.array_equal(wordtree.unpack(wordtree.pack(a, b), 2), [a, b])
    assert wordtree.unpack(wordtree.pack(a[:0], b[:0]), 2).shape == (2, 0)


def test_a_token_alone_gains_what_the_whole_tree_says():
    made = np.random.default_rng(2)
    n = 4000
    word = made.integers(0, 300, n).astype(np.uint32)
    one, two = made.integers(0, 2**31, n).astype(np.uint32), made.integers(0, 2**31, n).astype(np.uint32)
    train = made.random(n) < 0.8
    gain = wordtree.gains_of_words(word, one, two, train)
    assert np.allclose(gain[~train], 0, atol=1e-5)  # words before them never came
    want = np.zeros(300)
    counts = np.bincount(word[train], minlength=300)
    order = np.argsort(-counts, kind="stable")
    for lo, mid, hi, share in ((*map(int, x[:3]), x[3]) for nodes in wordtree.levels(counts[order] + 0.5) for x in zip(*nodes)):
        for w in range(lo, hi):
            p = start = share if w >= mid else 1 - share
            for prior in wordtree.PRIOR:
                odds = p / (1 - p) * (1 + 1 / (prior * p))
                p = odds / (1 + odds)
            want[order[w]] += np.log10(p / start)
    assert np.allclose(gain[train], want[word[train]], atol=1e-3)
