"""Language-model scores: a hashed maximum-entropy model over word counts of the whole corpus.

Counts.  Words are counted over all training texts; words are looked up in a head of frequent words that every worker
holds (at most ``HEAD``), and the rarer ones are joined to their counts by word, so no table is bounded
by the corpus.

Model.  Frequent words are symbols of their own; the others share a symbol by their last two bytes.
P(symbol | the two symbols before) is a softmax over classes times a softmax within the class, with weights for
the previous symbol, both symbols, the one before last alone (a skip) and a previous word without symbol of its own,
hashed into a fixed number of rows.  Tasks run gradient updates over their texts and the
weights are averaged, in two steps so that no task gathers those of all tasks.

Words of a symbol.  P(word | symbol, the two words before) is a tree of words (``wordtree``) with weights of the words
themselves, as many as the corpus needs.  Tokens move to the task of their symbol, packed; it knows all words of the symbol, learns
from the training texts and returns, per text, what the words before add to the words' logarithms.  A symbol with too many tokens or words
is dealt out in parts by word; which part it is learned by other tasks, dealt out by the word before.  A word that no training
text has is one event of its symbol (of its part); the words before say nothing about it within.

A null or empty text is its end token alone.  A null id counts as training.  Without training texts all
counts are 0 and weights stay at 0.  Repeated rows count as often as they come; other columns are not read, whatever
their names.  Texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import wordtree
from newsloom.llm.common import lower_words, ready_for_python
from newsloom.session import written_table

HEAD = 200_000
CLASSES, PER_CLASS = 16, 16
RARE = 64  # symbols that rare words share
OWN = CLASSES * PER_CLASS - RARE  # symbols of frequent words; 0 is the end of a text
ROWS = 4096  # hashed features
BLOCK_ROWS = 64  # rows of weights that travel together
BATCH = 16384  # tokens per gradient update
PART = 4096  # tokens scored at once
RATE = 0.4
FLUSH = 200_000  # words a task counts before it hands them on
SHARD_TOKENS = 2_000_000  # training tokens of a symbol in one task, and its words
SHARD_WORDS = 1_000_000
PARTITION_TOKENS = 200_000  # fewer tokens are not worth a task
WINDOW = 1 << 20  # tokens with a shared symbol that a task packs together
END = b""


def rare_symbol(word: bytes) -> int:
    return OWN + zlib.crc32(word[-2:]) % RARE


def training(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 5 != 1


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, rare, c) over all texts, each with its end; tasks add up what they see before the shuffle."""

    def rows(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": list(counts), "c": list(counts.values())})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch[text]:
                counts.update(lower_words(t))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield rows(counts)
                    counts.clear()
        if counts:
            yield rows(counts)

    partial = ready_for_python(df).select(text).mapInPandas(run, "word binary, c long")
    rare = F.lit(OWN) + F.crc32(F.substring("word", -2, 2)) % RARE  # as in rare_symbol
    return partial.groupBy("word").agg(F.sum("c").alias("c")).select("word", rare.cast("int").alias("rare"), "c")


def shards_of(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The parts of each shared symbol, and its first shard: one for each part, then, if there are several, as many that
    tell the parts apart."""
    sizes = np.array([len(p) for p in parts])
    return sizes, np.concatenate([[0], np.cumsum(np.where(sizes > 1, 2 * sizes, 1))])


def part_of(word: bytes, sizes: np.ndarray) -> int:
    """The part of its shared symbol that a word is in."""
    return zlib.crc32(word) % int(sizes[rare_symbol(word) - OWN])


def outside(places: np.ndarray, starts: np.ndarray, other: int) -> np.ndarray:
    """Where tokens are that the head does not have; ends are none."""
    beyond = places == other
    beyond[np.append(starts[1:], len(places)) - 1] = False
    return np.flatnonzero(beyond)


class Head:
    """What every worker holds: the frequent words' symbols and logarithms, the normalisers, and for each shared symbol
    the counts of its parts."""

    def __init__(self, words: list[bytes], counts: list[int], own: list[bytes], rare_norms: list[float], parts: list[list[float]] | None = None):
        self.words, self.own, self.rare_norms = words, own, rare_norms
        self.parts = [np.array(p) for p in parts or [[1.0]] * RARE]
        self.logs = np.log10(np.array([*counts, 0], np.float64) + 0.5)  # the last place is that of other words

    def ready(self) -> Head:
        if not hasattr(self, "place"):
            self.place = {w: i for i, w in enumerate(self.words)}
            symbols = {w: i for i, w in enumerate(self.own)}
            self.symbols = np.array([symbols[w] if w in symbols else rare_symbol(w) for w in self.words] + [0], np.int64)
            norms = np.zeros(CLASSES * PER_CLASS)
            norms[OWN:] = self.rare_norms
            self.norms = norms
            self.sizes, self.first = shards_of(self.parts)
            if self.sizes.max() > 1:
                self.part = np.array([part_of(w, self.sizes) for w in self.words] + [0], np.int64)
        return self

    def names(self, places: np.ndarray, starts: np.ndarray, rest: list[list[bytes]]) -> np.ndarray:
        """32 bits for each token: the place of a word of the head, a hash beyond these for others."""
        other = len(self.words)
        names = places.astype(np.uint32)
        names[outside(places, starts, other)] = [other + 1 + xxhash.xxh32_intdigest(w) % (2**32 - 1 - other) for words in rest for w in words]
        return names

    def look_up(self, found: list[bytes], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Places and symbols of some texts' tokens, each text with its end, and per text its words outside the head."""
        other = len(self.words)
        places = np.fromiter(map(self.place.get, found, itertools.repeat(other)), np.int64, len(found))
        symbols = self.symbols.take(places)
        at = outside(places, starts, other)
        words = [found[i] for i in at.tolist()]
        symbols[at] = [rare_symbol(w) for w in words]
        edges = [*np.searchsorted(at, starts).tolist(), len(words)]
        return places, symbols, [words[a:b] for a, b in itertools.pairwise(edges)]


def before(tokens: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The one before each token and the one before that; before a text stands its end."""
    one, two = np.full_like(tokens, end), np.full_like(tokens, end)
    one[1:] = tokens[:-1]
    two[2:] = tokens[:-2]
    one[starts] = end
    two[starts] = end
    two[np.minimum(starts + 1, len(tokens) - 1)] = end
    return one, two


def features(symbols: np.ndarray, starts: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
    """Rows of weights for each token: the word before if its symbol is shared, else always on; previous, both, skip."""
    one, two = before(symbols, starts, 0)
    words = np.zeros_like(one)
    if names is not None:
        word = before(names, starts, 0)[0].astype(np.int64)
        words = np.where(one < OWN, words, word + 1_000_000)
    out = np.empty((len(symbols), 4), np.int64)
    for k, value in enumerate((words, one + 1, 1000 + one * 256 + two, 500 + two)):
        out[:, k] = ((value * 0x9E3779B1) & 0xFFFFFFFF) >> 20
    return out


def exponentials(scores: np.ndarray) -> np.ndarray:
    """Of scores, in their place, less the largest of each row."""
    scores -= np.ascontiguousarray(scores.T).max(0)[:, None]  # rows are short, columns fast
    np.maximum(scores, -80, out=scores)  # no probability is 0
    return np.exp(scores, out=scores)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = exponentials(scores)
    e /= e.sum(1, keepdims=True)
    return e


class Model:
    """Weights of classes, ``rows x classes``, and of symbols in their class, ``rows x classes x symbols``."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((ROWS, CLASSES * (1 + PER_CLASS)), np.float32) if weights is None else weights
        self.classes = np.ascontiguousarray(self.weights[:, :CLASSES])
        self.inner = np.ascontiguousarray(self.weights[:, CLASSES:]).reshape(ROWS * CLASSES, PER_CLASS)
        self.class_sums = np.full(ROWS, 1e-3, np.float32)
        self.inner_sums = np.full(ROWS * CLASSES, 1e-3, np.float32)

    def packed(self) -> np.ndarray:
        return np.concatenate([self.classes, self.inner.reshape(ROWS, -1)], 1)

    @staticmethod
    def _scores(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = weights.take(rows[:, 0], 0)
        part = np.empty_like(out)
        for k in range(1, rows.shape[1]):
            out += weights.take(rows[:, k], 0, out=part, mode="clip")  # rows are in range; other modes copy
        return out

    def scores(self, rows: np.ndarray, symbols: np.ndarray):
        kind, place = symbols // PER_CLASS, symbols % PER_CLASS
        inner_rows = rows * CLASSES + kind[:, None]
        return kind, place, inner_rows, self._scores(self.classes, rows), self._scores(self.inner, inner_rows)

    def logs(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """log10 P of each token."""
        out = np.empty(len(symbols))
        for at in range(0, len(symbols), PART):
            part = slice(at, at + PART)
            kind, place, _, *scores = self.scores(rows[part], symbols[part])
            n = np.arange(len(kind))
            outer, inner = map(exponentials, scores)
            p, q = outer[n, kind] / outer.sum(1), inner[n, place] / inner.sum(1)
            out[part] = np.log10(p.astype(np.float64)) + np.log10(q.astype(np.float64))
        return out

    def update(self, rows: np.ndarray, symbols: np.ndarray) -> None:
        """One gradient step over a batch, with a step size for each row that falls with its gradients so far."""
        kind, place, inner_rows, *scores = self.scores(rows, symbols)
        outer, inner = map(softmax, scores)
        n = np.arange(len(kind))
        outer[n, kind] -= 1
        inner[n, place] -= 1
        self._step(self.classes, self.class_sums, rows, outer)
        self._step(self.inner, self.inner_sums, inner_rows, inner)

    @staticmethod
    def _step(weights: np.ndarray, sums: np.ndarray, rows: np.ndarray, errors: np.ndarray) -> None:
        flat = rows.T.ravel().astype(np.uint16)  # rows and rows x classes fit 16 bits, which sort fast
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        order -= order // len(errors) * len(errors)
        by_column = np.ascontiguousarray(errors.T).take(order, 1)
        total = np.ascontiguousarray(np.add.reduceat(by_column, starts, axis=1).T)
        touched = ordered[starts].astype(np.int64)
        sums[touched] += (total * total).mean(1)
        total *= RATE
        total /= np.sqrt(sums[touched])[:, None]
        weights[touched] -= total


def documents_in_blocks(texts: Iterator[str | None], head: Head) -> Iterator[tuple]:
    """Some texts at a time: symbols, starts, places, and per text the words outside the head."""

    def block() -> tuple:
        at = np.array(starts)
        places, symbols, rest = head.look_up(found, at)
        return symbols, at, places, rest

    found: list[bytes] = []
    starts: list[int] = []
    for t in texts:
        starts.append(len(found))
        found += lower_words(t)
        found.append(END)
        if len(found) >= BATCH:
            yield block()
            found, starts = [], []
    if starts:
        yield block()


def train(df: DataFrame, text: str, head, rounds: int = 1) -> np.ndarray:
    """Weights after ``rounds`` passes: each task updates its own copy, copies are averaged by their tokens."""
    spark = df.sparkSession
    weights = Model().packed()
    width = weights.shape[1]

    def averaged(frame: pd.DataFrame) -> pd.DataFrame:
        total, tokens = np.zeros(BLOCK_ROWS * width), 0
        for data, n in zip(frame["data"], frame["tokens"], strict=True):
            total += np.frombuffer(data, np.float32).astype(np.float64) * n
            tokens += n
        mean = (total / max(tokens, 1)).astype(np.float32)
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "part": [frame["part"].iloc[0]], "tokens": [tokens], "data": [mean.tobytes()]})

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            model, tokens = Model(shared.value.copy()), 0
            known = head.value.ready()
            for symbols, starts, places, rest in documents_in_blocks((t for b in batches for t in b[text]), known):
                rows = features(symbols, starts, known.names(places, starts, rest))
                for at in range(0, len(symbols), BATCH):
                    model.update(rows[at : at + BATCH], symbols[at : at + BATCH])
                tokens += len(symbols)
            if tokens:
                packed = model.packed()
                blocks = range(0, ROWS, BLOCK_ROWS)
                yield pd.DataFrame(
                    {"block": [b // BLOCK_ROWS for b in blocks], "tokens": tokens, "data": [packed[b : b + BLOCK_ROWS].tobytes() for b in blocks]}
                )

        made = ready_for_python(df).select(text).mapInPandas(run, "block int, tokens long, data binary")
        # copies per group: about the root of the number of tasks, here 32 to 1000
        step = "block int, part int, tokens long, data binary"
        made = made.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(32)))
        made = made.groupBy("block", "part").applyInPandas(averaged, step).withColumn("part", F.lit(0))
        merged = made.groupBy("block").applyInPandas(averaged, step).collect()  # one row per block of weights
        for row in merged:
            at = row["block"] * BLOCK_ROWS
            weights[at : at + BLOCK_ROWS] = np.frombuffer(row["data"], np.float32).reshape(BLOCK_ROWS, width)
    return weights


def head_of(counts: DataFrame, most: int = HEAD) -> tuple[Head, DataFrame, int, int]:
    """The head, the counts of all other words, the tokens and the distinct tokens."""
    size = F.floor(F.log2(F.col("c")) * 16).cast("int")
    levels = sorted(tuple(r) for r in counts.groupBy(size.alias("level")).agg(F.count(F.lit(1)), F.sum("c")).collect())  # at most some hundred
    distinct, tokens, held, lowest = sum(r[1] for r in levels), sum(r[2] for r in levels), 0, 0
    for level, n, _ in reversed(levels):
        held += n
        if held > most:
            lowest = level + 1
            break
    in_head = (size >= lowest) | (F.octet_length("word") == 0)  # the end is always at hand
    chosen = counts.filter(in_head).select("word", "rare", "c").collect()  # at most ``most`` rows and one
    chosen.sort(key=lambda r: (-r["c"], bytes(r["word"])))
    words, numbers = [bytes(r["word"]) for r in chosen], [r["c"] for r in chosen]
    own = [END, *[w for w in words if w != END][: OWN - 1]]
    by_rare = {r["rare"]: (r["n"], r["v"]) for r in counts.groupBy("rare").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    of_own = set(own)
    norms, sizes = [], []
    for symbol in range(OWN, OWN + RARE):
        n, v = by_rare.get(symbol, (0, 0))
        inside = [c for w, c in zip(words[: OWN + 1], numbers, strict=False) if w in of_own and rare_symbol(w) == symbol]
        norms.append(math.log10(n - sum(inside) + 0.5 * (v - len(inside) + 1)))
        sizes.append(max(1, math.ceil((n - sum(inside)) / SHARD_TOKENS), math.ceil((v - len(inside)) / SHARD_WORDS)))
    return Head(words, numbers, own, norms, masses(counts, of_own, sizes)), counts.filter(~in_head), tokens, distinct


def masses(counts: DataFrame, own: set[bytes], sizes: list[int]) -> list[list[float]]:
    """Per shared symbol the smoothed counts of its parts, without the words that have symbols of their own."""
    out = [[0.0] * n for n in sizes]
    if max(sizes) > 1:
        size = F.element_at(F.array(*map(F.lit, sizes)), F.col("rare") - OWN + 1)  # as in part_of
        part = (F.crc32("word") % size).cast("int")
        by_part = counts.filter(~F.col("word").isin([bytearray(w) for w in own])).groupBy("rare", part.alias("part"))
        for r in by_part.agg(F.sum(F.col("c") + 0.5).alias("mass")).collect():  # as many as there are parts
            out[r["rare"] - OWN][r["part"]] = r["mass"]
    return [[max(m, 0.5) for m in masses] for masses in out]


class Window:
    """Tokens with shared symbols, on their way to the shards."""

    def __init__(self, known: Head):
        self.known, self.columns, self.held, self.texts = known, [], 0, 0

    def add(self, symbols: np.ndarray, starts: np.ndarray, places: np.ndarray, rest: list[list[bytes]], names: np.ndarray, train: np.ndarray) -> None:
        known, at = self.known, np.flatnonzero(symbols >= OWN)
        one, two = before(names, starts, known.place.get(END, len(known.words)))
        text = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(symbols)))[at]
        group, word, one, two = symbols[at] - OWN, names[at], one[at], two[at]
        slot = ((self.texts + text) * 2 + train[text]).astype(np.uint32)
        shard = known.first[group]
        several = known.sizes[group] > 1
        if several.any():
            part = known.part[places]
            part[outside(places, starts, len(known.words))] = [part_of(w, known.sizes) for words in rest for w in words]
            part, size = part[at], known.sizes[group]
            told = shard + size + (wordtree.mixed(one.astype(np.uint64)) >> np.uint64(1)).astype(np.int64) % size
            self.columns.append([x[several] for x in (told, part.astype(np.uint32), one, two, slot)])
            shard = shard + part
        self.columns.append([shard, word, one, two, slot])
        self.held += len(at)
        self.texts += len(starts)

    def packed(self) -> Iterator[tuple[int, bytes]]:
        """(shard, its tokens) of what was added."""
        if self.held:
            shard, *columns = map(np.concatenate, zip(*self.columns, strict=True))
            order = np.argsort(shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard, kind="stable")
            shard, columns = shard[order], [c[order] for c in columns]
            starts = np.flatnonzero(np.diff(shard, prepend=-1))
            for a, b in itertools.pairwise([*starts.tolist(), len(shard)]):
                yield int(shard[a]), wordtree.pack(*(c[a:b] for c in columns))
        self.columns, self.held, self.texts = [], 0, 0


def learned_in_shard(shard: int, blobs: list[bytes], parts: list[np.ndarray]) -> Iterator[bytes]:
    """For each blob its texts and what the words before add to the logarithms of their tokens."""
    sizes, first = shards_of(parts)
    group = int(np.searchsorted(first, shard, "right")) - 1
    tokens = [wordtree.unpack(blob, 4) for blob in blobs]
    lengths = [t.shape[1] for t in tokens]
    word, one, two, slot = np.concatenate(tokens, axis=1)
    del tokens
    train = (slot & 1).astype(bool)
    if sizes[group] > 1 and shard - first[group] >= sizes[group]:  # which part
        gain = wordtree.gains(word.astype(np.int32), one, two, train, parts[group])
    else:
        gain = wordtree.gains_of_words(word, one, two, train)
    for a, b in itertools.pairwise(np.cumsum([0, *lengths]).tolist()):
        text = slot[a:b] >> 1
        new = np.flatnonzero(np.diff(text, prepend=-1))  # tokens of a text stand together
        yield wordtree.pack(text[new], np.add.reduceat(gain[a:b], new).astype(np.float32).view(np.uint32))


def score(df: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = 1, most: int = HEAD) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    chosen = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text"), training(id_col).alias("_train"))
    learned = chosen.filter("_train").select("_text")
    counts = written_table(word_counts(learned, "_text"), "counts")
    head, tail, tokens, distinct = head_of(counts, most)
    shared = spark.sparkContext.broadcast(head)
    weights = spark.sparkContext.broadcast(train(learned, "_text", shared, rounds))
    parts = head.parts
    partitions = min(int(shards_of(parts)[1][-1]), tokens // PARTITION_TOKENS + 1)
    kinds = T.StructType([
        T.StructField("_id", chosen.schema["_id"].dataType), T.StructField("_train", T.BooleanType()), T.StructField("_row", T.LongType()),
        *T.StructType.fromDDL("n_tokens long, n_head long, logs double, rare_logs double, model double, rest array<binary>, shard int, packed binary"),
    ])
    plain = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.int32(), pa.binary()]

    def only_packed(kind: pa.DataType, rows: list[int], shard: list[int], packed: list[bytes]) -> pa.RecordBatch:
        n = len(rows)
        empty = [pa.nulls(n, k) for k in (kind, pa.bool_(), *plain[1:7])]
        arrays = [*empty[:2], pa.array(rows, pa.int64()), *empty[2:], pa.array(shard, pa.int32()), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and rows with the tokens that go to a shard, counted from the row that is named."""
        known, model = shared.value.ready(), Model(weights.value)
        other = len(known.words)
        window, first = Window(known), TaskContext.get().partitionId() << 33
        row, kind = first, None
        for batch in batches:
            ids, texts, learning = batch.columns
            kind, learning, done, out = ids.type, learning.to_numpy(zero_copy_only=False).astype(bool), 0, []
            for symbols, starts, places, rest in documents_in_blocks(texts.to_pylist(), known):
                names = known.names(places, starts, rest)
                inside = places != other
                logs = np.where(inside, known.logs[places], 0.0)
                rare = symbols >= OWN
                each = model.logs(features(symbols, starts, names), symbols) - known.norms[symbols]
                sums = [np.add.reduceat(x, starts) for x in (np.ones(len(symbols), np.int64), inside.astype(np.int64), logs, np.where(rare, logs, 0.0), each)]
                out += list(zip(*sums, rest, strict=True))
                window.add(symbols, starts, places, rest, names, learning[done : done + len(starts)])
                done += len(starts)
            rows = np.arange(row, row + done)
            values = [rows, *zip(*out, strict=True), (rows % partitions).astype(np.int32), [None] * done] if done else [[]] * 9
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), *(pa.array(v, k) for v, k in zip(values, plain, strict=True))], kinds.names)
            row += done
            if window.held >= WINDOW:
                yield from handed_on(window, kind, first)
                first = row
        if window.held:
            yield from handed_on(window, kind, first)

    def handed_on(window: Window, kind: pa.DataType, first: int) -> Iterator[pa.RecordBatch]:
        for shard, packed in window.packed():
            yield only_packed(kind, [first], [shard], [packed])

    def in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of texts as they are; of packed rows what their shards make of them."""
        held: dict[int, list[tuple[int, bytes]]] = {}
        kind = None
        for batch in batches:
            packed = batch.column("packed")
            yield batch.filter(packed.is_null())
            kind, some = batch.column("_id").type, batch.filter(packed.is_valid())
            for row, shard, data in zip(*(some.column(c).to_pylist() for c in ("_row", "shard", "packed")), strict=True):
                held.setdefault(shard, []).append((row, data))
        for shard in sorted(held):
            rows, blobs = zip(*sorted(held.pop(shard)), strict=True)
            made = list(learned_in_shard(shard, list(blobs), parts))
            yield only_packed(kind, list(rows), [shard] * len(rows), made)

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        """Per text the sum of what the shards say."""
        texts, gains = np.concatenate([wordtree.unpack(p, 2) for p in frame.sort_values("shard")["packed"]], axis=1)
        total = np.bincount(texts, np.ascontiguousarray(gains).view(np.float32))
        return pd.DataFrame({"_row": frame["_row"].iloc[0] + np.arange(len(total)), "gain": total})

    made = ready_for_python(chosen).select("_id", "_text", "_train").mapInArrow(run, kinds)
    dealt = made.repartitionById(partitions, F.col("shard") % partitions).mapInArrow(in_shards, kinds)
    scored = written_table(dealt, "scored")
    gained = scored.filter("packed is not null").select("_row", "shard", "packed").groupBy("_row").applyInPandas(added, "_row long, gain double")
    scored = scored.filter("packed is null").drop("shard", "packed")
    words = scored.select("_row", F.explode("rest").alias("word")).join(tail.select("word", "c"), "word", "left")
    known = F.coalesce(F.col("c"), F.lit(0))
    rest = words.groupBy("_row").agg(
        F.sum((known > 0).cast("long")).alias("tail_known"), F.sum(F.log10(known + 0.5)).alias("tail_logs")
    )
    joined = scored.drop("rest").join(rest, "_row", "left").join(gained, "_row", "left").fillna(0, ["tail_known"]).fillna(0.0, ["tail_logs", "gain"])
    # an end that no training text has is an unknown token in the head's place
    unseen = 0.0 if tokens else math.log10(0.5)
    norm = math.log10(tokens + 0.5 * (distinct + 1))
    return joined.select(
        F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), "n_tokens",
        (F.col("n_head") + F.col("tail_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("tail_logs") + F.lit(unseen) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("model") + F.col("rare_logs") + F.col("tail_logs") + F.col("gain")).alias("score"),
    )
