"""Words told apart by the words before them: a maximum-entropy model at every node of a tree of words.

The words of one vocabulary are the leaves of a binary tree, balanced by their counts, so each word is a leaf of its own and a
frequent one is near the root.  A node goes right with the probability sigma(base + weights of the previous word, of the one before it
alone (a skip) and of both), where ``base`` is what the counts say.  Weights stand for (node, words) pairs that training texts have, so
there are as many as the texts need; they are found one kind of feature after the other, each by a scaling step towards the counts with
``PRIOR`` imagined tokens that behave as without it.  Such a step needs sums only, so the order of the tokens does not matter.

A node sees only tokens that come to it, and all of them; levels are done one after another and no weights outlive theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard

PRIOR = (2.0, 4.0, 1.0)  # of previous word, skip, both
LEAST = 1e-6  # probability that weights are made from
KEEP = 0.85  # tokens are packed anew when fewer than this share are left
U = np.uint64


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, byte by byte, so that small numbers take little."""
    planes = [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(columns, 4, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[:, :, 0]


def levels(mass: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The inner nodes of the tree by level: first word, first word to the right, end, and the share of the right side."""
    edges = np.concatenate([[0.0], np.cumsum(mass)])
    lo, hi = np.array([0]), np.array([len(mass)])
    while True:
        wide = hi - lo > 1
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            return
        twice = edges[lo] + edges[hi]
        mid = np.searchsorted(edges, twice / 2)
        mid -= edges[mid] + edges[mid - 1] > twice  # the edge before is nearer
        mid = np.clip(mid, lo + 1, hi - 1)
        yield lo, mid, hi, (edges[hi] - edges[mid]) / (edges[hi] - edges[lo])
        lo, hi = np.stack([lo, mid], 1).ravel(), np.stack([mid, hi], 1).ravel()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Order:
    """Tokens in the order of one feature's words and then of the tree, where the tokens of a weight stand together.

    Equal tokens are one, with a number of training tokens.  One that is alone with its words at a node stays so further down,
    and what its weights are there needs no other token: it leaves.
    """

    def __init__(self, key: np.ndarray, at: np.ndarray, train: np.ndarray, bits: int, prior: float):
        key = key >> U(bits)
        self.at = at
        self.context = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
        self.train, self.prior = train[self.at], prior
        self.before = sums(self.train, np.int32)
        self.alone = np.zeros(0, np.int32)  # training tokens that left

    def leave(self, keep: np.ndarray) -> None:
        self.at, self.context, self.train = self.at[keep], self.context[keep], self.train[keep]
        self.before = sums(self.train, np.int32)

    def step(self, node: np.ndarray, right: np.ndarray, side: np.ndarray, train: np.ndarray, z: np.ndarray, share: np.ndarray | None) -> None:
        """Adds to ``z`` the weights of this feature; the first one is given the nodes' shares."""
        if len(self.alone):
            s = side[self.alone]
            z[self.alone] += s * weight_alone(s * z[self.alone], self.prior, train[self.alone])
        if not len(self.at):
            return
        node, right = node[self.at], right[self.at]
        new = np.empty(len(node), bool)
        new[0] = True
        np.not_equal(self.context[1:], self.context[:-1], out=new[1:])
        new[1:] |= node[1:] != node[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(node))
        n = (self.before[ends] - self.before[starts]).astype(np.float32)
        ones = sums(right * self.train, np.int32)
        ones = (ones[ends] - ones[starts]).astype(np.float32)
        own = z[self.at]
        if share is not None:
            mean = share[node[starts]]
        else:
            p = sums(sigma(own) * self.train, np.float64)
            mean = ((p[ends] - p[starts]) / np.maximum(n, 1)).astype(np.float32)
            mean[n == 0] = 0.5
            np.clip(mean, LEAST, 1 - LEAST, out=mean)
        found = (ones + self.prior * mean) * (1 - mean)
        found /= (n - ones + self.prior * (1 - mean)) * mean
        own += np.log(found, out=found)[np.cumsum(new, dtype=np.int32) - 1]
        z[self.at] = own
        single = ends - starts == 1
        if np.count_nonzero(single) > (1 - KEEP) * len(node):
            gone = starts[single]
            self.alone = np.concatenate([self.alone, self.at[gone[self.train[gone] > 0]]])
            keep = np.ones(len(node), bool)
            keep[gone] = False
            self.leave(keep)


def weight_alone(z: np.ndarray, prior: float, train: np.ndarray | int = 1) -> np.ndarray:
    """The weight, towards its side, of a training token's feature that no other token has at a node."""
    p = np.clip(sigma(z), LEAST, 1 - LEAST)
    p *= prior
    return np.log1p(train / p, dtype=np.float32)


def sorted_keys(context: np.ndarray, rank: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Words before in the upper bits, hashed, and the token's word in the lower ones; and which token each is of."""
    key = (mixed(context) << U(bits)) | rank.astype(U)
    at = np.argsort(key).astype(np.int32)
    return key[at], at


def sums(x: np.ndarray, kind: type) -> np.ndarray:
    """Of all values before each place, and of all."""
    out = np.empty(len(x) + 1, kind)
    out[0] = 0
    np.cumsum(x, dtype=kind, out=out[1:])
    return out


def sigma(z: np.ndarray) -> np.ndarray:
    out = np.exp(-z)
    out += 1
    return np.divide(1, out, out=out)


def log_sigma(z: np.ndarray) -> np.ndarray:
    out = np.exp(-z)
    np.log1p(out, out=out)
    return np.negative(out, out=out)


def gains_of_words(word: np.ndarray, one: np.ndarray, two: np.ndarray, train: np.ndarray) -> np.ndarray:
    """As ``gains``, for the vocabulary of the training tokens and its counts; others gain nothing."""
    words, counts = np.unique(word[train], return_counts=True)
    out = np.zeros(len(word))
    if not len(words):
        return out
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(words), np.int32)
    rank[order] = np.arange(len(words), dtype=np.int32)
    place = np.minimum(np.searchsorted(words, word), len(words) - 1).astype(np.int32)
    known = words[place] == word
    rank = rank[place[known]]
    del place
    out[known] = gains(rank, one[known], two[known], train[known], counts[order] + 0.5)
    return out


class Level:
    """The nodes of one level, seen from the words."""

    def __init__(self, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, share: np.ndarray, words: int):
        k = len(lo)
        inside = np.zeros(words + 1, np.int8)
        inside[lo] += 1
        inside[hi] -= 1
        self.inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        self.node, self.right = np.full(words, k, np.int32), np.zeros(words, bool)
        self.node[self.inside] = np.repeat(np.arange(k, dtype=np.int32), hi - lo)
        self.right[self.inside] = np.flatnonzero(self.inside) >= np.repeat(mid, hi - lo)
        self.share = np.append(share, 0.5).astype(np.float32)  # the last is that of words that are done
        self.base = np.log(self.share / (1 - self.share))
        self.start = log_sigma(np.stack([-self.base, self.base], 1)).ravel()  # logarithms of the left and the right share
        self.start[-2:] = 0

    def alone(self) -> np.ndarray:
        """Per word what a training token gains here none of whose features another token has."""
        z = np.stack([-self.base, self.base], 1).ravel()
        for prior in PRIOR:
            z = z + weight_alone(z, prior)
        more = log_sigma(z) - self.start
        more[-2:] = 0
        return more.astype(np.float64)[self.node * 2 + self.right]


def gains(rank: np.ndarray, one: np.ndarray, two: np.ndarray, train: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """For each token log10 of P(word | the two words before) over its share of ``mass``; tokens name words by their place there."""
    if len(mass) < 2 or not len(rank):
        return np.zeros(len(rank))
    bits = int(len(mass)).bit_length()
    key, at = sorted_keys((one.astype(U) << U(32)) | two, rank, bits)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    starts = np.flatnonzero(new)
    same = np.empty(len(rank), np.int32)
    same[at] = np.cumsum(new, dtype=np.int32) - 1
    counts = np.add.reduceat(train[at], starts, dtype=np.int32)
    first, key = at[starts], key[starts]
    del at, new, starts
    return gains_of_different(rank[first], one[first], two[first], key, counts, mass, bits)[same]


def gains_of_different(
    rank: np.ndarray, one: np.ndarray, two: np.ndarray, key: np.ndarray, train: np.ndarray, mass: np.ndarray, bits: int
) -> np.ndarray:
    """As ``gains``, for tokens of which no two are equal, by ``key`` of both words, with the number of training tokens of each."""
    out = np.zeros(len(rank))
    orders = [Order(*sorted_keys(c.astype(U), rank, bits), train, bits, prior) for c, prior in zip((one, two), PRIOR)]
    orders.append(Order(key, np.arange(len(key), dtype=np.int32), train, bits, PRIOR[2]))
    del one, two, key
    left = np.zeros(len(mass))  # what a token alone that comes once gains from here on
    for nodes in levels(mass):
        left += Level(*nodes, len(mass)).alone()
    ids = np.arange(len(rank), dtype=np.int32)
    gain = np.zeros(len(rank), np.float32)
    for nodes in levels(mass):
        level = Level(*nodes, len(mass))
        busy = train > 1
        for o in orders:
            busy[o.at] = True
        keep = busy & level.inside[rank]
        if np.count_nonzero(keep) < KEEP * len(keep):
            out[ids] += gain
            bare = ~busy
            bare &= train == 1
            out[ids[bare]] += left[rank[bare]]
            place = np.cumsum(keep, dtype=np.int32) - 1
            for o in orders:
                o.leave(keep[o.at])
                o.at, o.alone = place[o.at], place[o.alone[keep[o.alone]]]
            ids, rank, train = ids[keep], rank[keep], train[keep]
            gain = np.zeros(len(ids), np.float32)
        node, right = level.node[rank], level.right[rank]
        side = np.where(right, np.float32(1), np.float32(-1))
        z = level.base[node]
        for o in orders:
            o.step(node, right, side, train, z, level.share if o is orders[0] else None)
        z *= side
        more = log_sigma(z)
        more -= level.start[node * 2 + right]
        more[node == len(level.share) - 1] = 0
        gain += more
        left -= level.alone()
    out[ids] += gain
    return out / np.log(10)
