"""Work that is done once: sets of chosen texts, pieces, looked up words."""

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from newsloom.llm import bpe, lm, minhash


def test_sets_are_made_of_chosen_texts_only(spark):
    texts = spark.createDataFrame([(k, f"a b c d e f g {k}") for k in range(20)], "k long, _text string")
    chosen = texts.join(F.broadcast(spark.range(3).withColumnRenamed("id", "k")), "k", "left_semi")
    nodes = minhash.sets_of(chosen, "_text").select("fp").distinct()
    joined = minhash.sets_of(chosen, "_text").join(F.broadcast(nodes), "fp")
    plan = minhash.sets_of(chosen, "_text").filter("fp is not null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("LeftSemi")
    assert joined.count() == 3


def test_packed_ids_are_those_of_encode():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        known = bpe.vocabulary(file.read(), public_tokenizers.PATTERN)
    for text in (None, "", "It's odd: 12 aaaaaaaaaaaa\n\n  ", "ä漢 \U0001f600" * 30, "x" * 200):
        assert known.packed(text) == np.array(known.encode(text), "<u4").tobytes()
        assert known.decode(known.encode(text)) == (text or "").encode()


def test_short_pieces_are_done_many_at_a_time_and_as_their_tables_say():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        known = bpe.Vocabulary(bpe.read_ranks(file.read()), public_tokenizers.PATTERN)
    made = np.random.default_rng(3)
    pieces = [made.choice(np.frombuffer(letters, np.uint8), n).tobytes() for letters in (b"ab", b" theraning", bytes(range(256))) for n in range(0, 64, 3) for _ in range(9)]
    want = [np.array(known.walk(known.extend(p, [])), "<u4").tobytes() for p in pieces]
    assert known.short_pieces(pieces) == want
    assert known.short_pieces([]) == []


def test_pieces_that_come_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 10)
    monkeypatch.setattr(bpe, "AT_ONCE", 10)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        known = bpe.Vocabulary(bpe.read_ranks(file.read()), public_tokenizers.PATTERN)
    done, whole = [], known.short_pieces
    monkeypatch.setattr(known, "short_pieces", lambda pieces: done.extend(pieces) or whole(pieces))
    texts = [f" zqxoften {''.join('qxzwvk'[k // 6**i % 6] for i in range(9))} again" for k in range(1, 60)] + ["x" * 200, None]
    assert [bpe.unpack(p) for p in known.all_packed(texts)] == [known.encode(t) for t in texts]
    assert done.count(b" zqxoften") == 1
    assert len(known.pieces) + len(known.before) < 60 and "x" * 200 not in known.pieces


def test_texts_of_a_block_are_looked_up_at_once():
    head = lm.Head([b"the", b"", b"cat"], [5, 3, 2], [b"", b"the"], [0.0] * lm.RARE).ready()
    texts = ["The cat sat", "", None, "dog the"]
    [(symbols, starts, places, rest)] = lm.documents_in_blocks(iter(texts), head)
    assert starts.tolist() == [0, 4, 5, 6]
    assert places.tolist() == [0, 2, 3, 1, 1, 1, 3, 0, 1]
    assert rest == [[b"sat"], [], [], [b"dog"]]
    assert symbols.tolist() == [1, lm.rare_symbol(b"cat"), lm.rare_symbol(b"sat"), 0, 0, 0, lm.rare_symbol(b"dog"), 1, 0]


def test_words_travel_alone_and_get_their_shared_symbol_when_counted(spark):
    texts = spark.createDataFrame([("a Bc déf \U0001f600 a",), ("",), (None,), ("bc xyz",)], "text string")
    counts = lm.word_counts(texts, "text")
    got = {bytes(r["word"]): (r["rare"], r["c"]) for r in counts.collect()}
    want = {"a": 2, "bc": 2, "déf": 1, "\U0001f600": 1, "xyz": 1, "": 4}
    assert got == {w.encode(): (lm.rare_symbol(w.encode()), c) for w, c in want.items()}
    plan = counts._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "hashpartitioning(word" in line]
    assert moved and not any("rare" in line for line in moved)


def test_a_step_adds_gradients_row_by_row():
    made = np.random.default_rng(5)
    rows = made.integers(0, lm.ROWS, (500, 4)) % [1, 7, 90, lm.ROWS]
    symbols = made.integers(0, lm.CLASSES * lm.PER_CLASS, 500)
    model = lm.Model()
    model.update(rows, symbols)
    kind = symbols // lm.PER_CLASS
    errors = np.full((500, lm.CLASSES), 1 / lm.CLASSES)
    errors[np.arange(500), kind] -= 1
    total = np.zeros((lm.ROWS, lm.CLASSES))
    for k in range(4):
        np.add.at(total, rows[:, k], errors)
    touched = np.unique(rows)
    step = lm.RATE * total[touched] / np.sqrt(1e-3 + (total[touched] ** 2).mean(1))[:, None]
    assert np.allclose(model.classes[touched], -step, atol=1e-4)
    assert np.count_nonzero(model.classes.any(1)) == len(touched)
