"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has one encoding, so one last token.  A token that ends a prefix is its
last token exactly if it starts the piece, or if the last token of what stands before it stays apart
from it when the merges run over both.  One pass over the bytes therefore yields the encoding of all
prefixes; that of the whole piece is read off backwards.  Bytes that are appended later extend the
table, and after an edit only the pieces around it are done anew.

Short pieces that nobody extends are done many at a time, and of their prefixes only those on the way to
the whole are settled: from a settled prefix the longest token that starts there and stays apart from its
last token settles the next one, from which the search goes back if nothing goes on from it.  A prefix has
one encoding, so none is settled twice.

Nulls: a null text has no tokens.  Very long texts and pieces take time in proportion to their
length.  Repeated rows are encoded as often as they come.  Other columns pass through, whatever their
names; a column named as the result is replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import ready_for_python

NEVER = 1 << 62
# entries of the tables a Python worker keeps to save work (some 100 MB in all); a full one is emptied
CACHED, CACHED_BORDERS = 100_000, 150_000  # of pieces, the table before is kept too
SLOTS = 19  # binary digits of a border's place in a table of fixed size
SHORT = 64  # bytes of pieces that are kept, and done many at a time
AT_ONCE = 100_000  # pieces that are looked up together


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines ``base64 rank`` of a vocabulary file."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def piece_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern with white space as Unicode defines it, as in Rust's regular expressions."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Vocabulary:
    """Ranks of tokens with the merge that makes each, and the border test between two tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = piece_pattern(pattern)
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.made = {t: r for t, r in ranks.items() if len(t) == 1}  # what merges can reach
        self.joins: dict[tuple[int, int], int] = {}
        self.right = {r: (r,) for r in self.made.values()}  # tokens at the right edge, first made first
        self.left = {r: (r,) for r in self.made.values()}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) > 1:
                self._learn(token, rank)
        # what tokens end with, to stop looking early: a token's rank, or -1 for a mere ending
        self.tails = dict.fromkeys((t[k:] for t in self.made for k in range(len(t))), -1) | self.made
        self.lengths = {rank: len(token) for rank, token in self.bytes.items()}
        # packed ids of pieces: a full table is put aside, and what is asked for again comes back from there
        self.pieces: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.borders: dict[int, bool] = {}  # by both tokens in one number
        self.slots = np.full(1 << SLOTS, -1), np.zeros(1 << SLOTS, bool)  # the same for many at once: the last border of each place
        self._plant()

    def _plant(self) -> None:
        """Arrays for many pieces at once: by what tokens start with and a byte, what they start with then, and its token."""
        inner = {b"": 0} | {h: k for k, h in enumerate(sorted({t[:n] for t in self.made for n in range(1, len(t))}), 1)}
        nodes = inner | {t: k for k, t in enumerate((t for t in self.made if t not in inner), len(inner))}
        self.inner = len(inner)
        self.child = np.full((self.inner, 256), -1, np.int32)
        self.token = np.full(len(nodes) + 1, -1)  # the last one is that of no node
        size = max(self.bytes, default=0) + 1
        self.shorter, self.size = np.full(size, -1), np.zeros(size, np.int64)
        for head, node in nodes.items():
            self.token[node] = rank = self.made.get(head, -1)
            if head:
                self.child[inner[head[:-1]], head[-1]] = node
            if rank >= 0:  # the longest other token that it starts with
                self.size[rank] = len(head)
                self.shorter[rank] = next((self.made[head[:k]] for k in range(len(head) - 1, 0, -1) if head[:k] in self.made), -1)

    def _learn(self, token: bytes, rank: int) -> None:
        """A token is made of the two parts that the earlier merges leave of its bytes."""
        for k in range(1, len(token)):
            a, b = self.made.get(token[:k], rank), self.made.get(token[k:], rank)
            if a < rank and b < rank and self.apart(a, b):
                self.joins[a, b] = rank
                self.made[token] = rank
                self.right[rank] = (*self.right[b], rank)
                self.left[rank] = (*self.left[a], rank)
                return

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border when the bytes of both tokens are encoded together.

        Merges run by rank, so the tokens that touch the border change at the ranks along a's right and
        b's left edge.  A join of those that touch happens if it comes before either grows away; of
        equal ranks the left place goes first.
        """
        left, right = self.right[a], self.left[b]
        i = j = 0
        while True:
            grown_a = left[i + 1] if i + 1 < len(left) else NEVER
            grown_b = right[j + 1] if j + 1 < len(right) else NEVER
            join = self.joins.get((left[i], right[j]), NEVER)
            if join < grown_a and join <= grown_b and join != NEVER:
                return False
            if grown_a == NEVER and grown_b == NEVER:
                return True
            if grown_a <= grown_b:
                i += 1
            else:
                j += 1

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Last tokens of all prefixes of ``piece``; ``last`` holds those of a shorter prefix."""
        last, tail, borders = last[: len(piece)], self.tails.get, self.borders
        known, add = borders.get, last.append
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(end - 1, 0, -1):
                token = tail(piece[start:end])
                if token is None:
                    add(self.made[piece[:end]])  # no token after the first byte fits, so one token is all of it
                    break
                if token >= 0:
                    pair = last[start - 1] << 32 | token
                    apart = known(pair)
                    if apart is None:
                        if len(borders) >= CACHED_BORDERS:
                            borders.clear()
                        apart = borders[pair] = self.apart(last[start - 1], token)
                    if apart:
                        add(token)
                        break
            else:
                add(self.made[piece[:end]])
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens stands for."""
        out, end, lengths = [], len(last), self.lengths
        while end:
            token = last[end - 1]
            out.append(token)
            end -= lengths[token]
        out.reverse()
        return out

    def _longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The longest token from each place on, within the piece."""
        best = np.full(len(at), -1)
        who, heads = np.arange(len(at)), np.zeros(len(at), np.int32)
        while len(who):
            heads = self.child[heads, data[at]]
            token = self.token[heads]
            hit = token >= 0
            best[who[hit]] = token[hit]
            at = at + 1
            on = (heads >= 0) & (heads < self.inner) & (at < ends)
            who, heads, at, ends = who[on], heads[on], at[on], ends[on]
        return best

    def _all_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``apart`` of many borders."""
        pair = a << 32 | b
        place = (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
        held, apart = self.slots
        out, new = apart[place], np.flatnonzero(held[place] != pair)
        if len(new):
            own, where = np.unique(pair[new], return_inverse=True)
            out[new] = np.array([self.apart(p >> 32, p & 0xFFFFFFFF) for p in own.tolist()])[where]
            held[place[new]] = pair[new]
            kept = held[place] == pair  # of new ones with one place the last
            apart[place[kept]] = out[kept]
        return out

    def short_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces, all of which go on a token at a time, or back if none fits."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        at, depth, out = ends - sizes, np.zeros(len(pieces), np.int64), np.zeros((len(pieces), sizes.max(initial=0)), np.int64)
        who = np.flatnonzero(sizes)
        token = self._longest(data, at[who], ends[who])
        while len(who):
            fits = token >= 0
            tested = np.flatnonzero(fits & (depth[who] > 0))
            fits[tested] = self._all_apart(out[who[tested], depth[who[tested]] - 1], token[tested])
            back = np.flatnonzero(token < 0)
            w = who[back]
            depth[w] -= 1
            if (depth[w] < 0).any():
                raise KeyError("bytes that no token stands for")
            token[back] = out[w, depth[w]]
            at[w] -= self.size[token[back]]
            w, found = who[fits], token[fits]
            token[~fits] = self.shorter[token[~fits]]
            out[w, depth[w]] = found
            depth[w] += 1
            at[w] += self.size[found]
            on = at[w] < ends[w]
            more = np.flatnonzero(fits)[on]
            token[more] = self._longest(data, at[w[on]], ends[w[on]])
            left = at[who] < ends[who]
            who, token = who[left], token[left]
        packed = out[np.arange(out.shape[1]) < depth[:, None]].astype("<u4").tobytes()
        edges = [0, *(np.cumsum(depth) * 4).tolist()]
        return [packed[a:b] for a, b in itertools.pairwise(edges)]

    def look_up(self, parts: set[str]) -> list[str]:
        """Have the ids of all ``parts`` at hand; returns the long ones, which are not to be kept."""
        if len(self.pieces) >= CACHED:
            self.pieces, self.before = {}, self.pieces
        wanted = parts.difference(self.pieces)
        again = wanted.intersection(self.before)
        self.pieces.update((p, self.before[p]) for p in again)
        short, long = [], []
        for part in wanted.difference(again):
            data = part.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                self.pieces[part] = struct.pack("<I", rank)
            else:
                (short if len(data) <= SHORT else long).append((part, data))
        self.pieces.update(zip((part for part, _ in short), self.short_pieces([data for _, data in short]), strict=True))
        for part, data in long:
            self.pieces[part] = np.array(self.walk(self.extend(data, [])), "<u4").tobytes()
        return [part for part, _ in long]

    def all_packed(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32 bits."""
        waiting: list[list[str]] = []
        size = 0
        for parts in itertools.chain((self.pattern.findall(t or "") for t in texts), [None]):
            if parts is not None:
                waiting.append(parts)
                size += len(parts)
            if parts is None or size >= AT_ONCE:
                long = self.look_up(set().union(*waiting))
                out = [b"".join(map(self.pieces.__getitem__, p)) for p in waiting]
                for part in long:
                    del self.pieces[part]
                waiting, size = [], 0
                yield from out

    def packed(self, text: str | None) -> bytes:
        return next(self.all_packed([text]))

    def encode(self, text: str | None) -> list[int]:
        return unpack(self.packed(text))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Encoded:
    """A text with its pieces and their tables, for appends and edits.

    A piece depends on the text from its start on, and of what follows only on whether the run goes on;
    so all pieces but the last two stay when text is appended, and after an edit old pieces hold again
    from the first border that is a border as before.
    """

    def __init__(self, vocabulary: Vocabulary, text: str = ""):
        self.vocabulary, self.text = vocabulary, ""
        self.starts: list[int] = []
        self.tables: list[list[int]] = []
        self.append(text)

    def _split(self, start: int) -> Iterator[tuple[int, str]]:
        return ((m.start(), m.group()) for m in self.vocabulary.pattern.finditer(self.text, start))

    def append(self, more: str) -> None:
        keep = max(0, len(self.starts) - 2)
        start = self.starts[keep] if self.starts else 0
        old = dict(zip(self.starts[keep:], self.tables[keep:], strict=True))
        ends = dict(zip(self.starts[keep:], [*self.starts[keep + 1 :], len(self.text)], strict=False))
        before, self.text = self.text, self.text + more
        del self.starts[keep:], self.tables[keep:]
        for at, piece in self._split(start):
            known = []
            if at in old and piece.startswith(before[at : ends[at]]):
                known = old[at]
            self.starts.append(at)
            self.tables.append(self.vocabulary.extend(piece.encode(), known))

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` on."""
        moved = len(inserted) - removed
        first = max(0, bisect.bisect_right(self.starts, at) - 3)
        start = self.starts[first] if self.starts else 0
        kept = {s + moved: k for k, s in enumerate(self.starts) if s >= at + removed}
        self.text = self.text[:at] + inserted + self.text[at + removed :]
        starts, tables = self.starts[:first], self.tables[:first]
        for place, piece in self._split(start):
            if place in kept and place >= at + len(inserted):
                rest = kept[place]
                starts += [s + moved for s in self.starts[rest:]]
                tables += self.tables[rest:]
                break
            starts.append(place)
            tables.append(self.vocabulary.extend(piece.encode(), []))
        self.starts, self.tables = starts, tables

    @property
    def ids(self) -> list[int]:
        out: list[int] = []
        for start, end, last in zip(self.starts, [*self.starts[1:], len(self.text)], self.tables, strict=False):
            whole = self.vocabulary.ranks.get(self.text[start:end].encode())
            out += [whole] if whole is not None else self.vocabulary.walk(last)
        return out


_loaded: dict[tuple[int, str], Vocabulary] = {}


def vocabulary(data: bytes, pattern: str) -> Vocabulary:
    """The vocabulary of a file's bytes, built once in each Python process."""
    key = (hash(data), pattern)
    if key not in _loaded:
        _loaded[key] = Vocabulary(read_ranks(data), pattern)
    return _loaded[key]


def token_bytes(data: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in read_ranks(data).items()}


def _shipped(df: DataFrame, path: str):
    """The vocabulary file (below a megabyte) for the workers, which need not have the path."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", packed: bool = False) -> DataFrame:
    """Add the token ids of ``text``: ``array<int>``, or ``packed`` as little-endian unsigned 32 bits."""
    shipped = _shipped(ready_for_python(df), path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = vocabulary(shipped.value, pattern)
        for texts in batches:
            ids = known.all_packed(texts)
            yield pd.Series([i if packed else np.frombuffer(i, "<u4").astype(np.int32) for i in ids], dtype=object)

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    return df.withColumn(out, F.pandas_udf(run, kind)(F.col(f"`{text}`")))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes that ids stand for, packed or in an array; null ids stand for none."""
    shipped = _shipped(ready_for_python(df), path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = token_bytes(shipped.value)
        for rows in batches:
            yield pd.Series([b"".join(map(known.__getitem__, unpack(r))) for r in rows], dtype=object)

    return df.withColumn(out, F.pandas_udf(run, T.BinaryType())(F.col(f"`{ids}`")))


def unpack(ids) -> list[int]:
    if ids is None:
        return []
    return (np.frombuffer(ids, "<u4") if isinstance(ids, (bytes, bytearray, memoryview)) else np.asarray(ids)).tolist()


def batched(ids: list[int], size: int) -> Iterator[list[int]]:
    """Ids in blocks of a context length, as a trainer takes them."""
    rest = iter(ids)
    while block := list(itertools.islice(rest, size)):
        yield block
