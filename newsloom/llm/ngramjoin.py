"""Similarity join on word n-grams by rare-first prefix filtering.

Two sets that are similar enough share one of their first members, if all sets are read in one order; a set needs only
as many first members as it may differ in.  The order here is rare first: n-grams whose hash lies in the counted part of
the hash range are counted over the whole corpus, and come by powers of two of their counts (looked up in a table of fixed size, where
n-grams that share a slot take the larger count), then by hash; those not counted stand with the rarest, after them by hash.  Any order
that is the same for all sets gives right results; this one keeps frequent n-grams out of the prefixes.

Texts are joined on the n-grams of their prefixes.  Pairs that meet are tested on length, on the places of the n-gram in both
(positional filter), and on whether they have an odd or an even number of members in each part of the hash range: every part
that differs holds a member of one set alone, and two sets so similar have few of these (suffix filter).  Larger sets are cut into more
parts, so the filter does not fade with length.  What passes is verified on the full sets, once per pair.

Equal sets are one node, so copies cost one row.  Of n-grams with the same texts the first is taken.  In the first rounds, each
n-gram's nodes are dealt into small chunks, and every chunk names pairs that would join all that its filters leave, the most promising first:
fewer pairs than rows.  An n-gram whose nodes are all in one chunk is done with if that chunk named all that its filters leave, mostly nothing.
Then only pairs of different components are of interest, and all of them are tested: of the n-grams left, the nodes outside an n-gram's
largest component meet all its nodes of fitting length, both cut into blocks, so a task holds two blocks of bounded size at a time.
The first rounds end when they hardly join anything any more; what they did not look at the last one tests.
No link between different components is left out, and components are all that the result needs.

Members of sets are 64-bit hashes: two different n-grams of a pair of texts are taken for one with probability below 1e-13 for
texts of a thousand words.  Equal sets, and n-grams with the same texts, are recognised by 128 bits.  Nothing else is approximate.

A text without words is linked with nothing and is its own component; null is such a text.  A row without id can be linked, and its component is named
by the smallest id in it (null if there is none).  Rows that share an id are judged by their own texts.  Texts of any length are read
whole.  An empty table gives an empty result.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import minhash
from newsloom.llm.common import lower_words, ready_for_python
from newsloom.llm.minhash import U, components, shingles
from newsloom.operators.joins import SPREAD_ROWS, fits_broadcast, frequent, join_checked, spread_join
from newsloom.operators.keys import number_rows
from newsloom.session import written_table

WIDTH = 3
PERCENT = 90
COUNTED = 1 << 62  # hashes below are counted: a quarter of the range
SLOTS = 1 << 24  # bytes that tell every worker how often n-grams occur
PAGE = 1 << 12  # slots that are collected together
AT_ONCE = 20_000  # rows whose pairs are compared together
PARTS = 512, 4096  # least and most parts of the hash range, powers of two; a bit for each moves with a node
BROADCAST = 8 << 20  # bytes sent to all at once, as measured; as a hash table they are several times that, of which the driver holds copies
CHUNK = 64
ROUNDS = 3
ENOUGH = 0.02  # a round that adds a smaller share of the links so far is followed by the last
BLOCK = 400_000  # members of all sets in a block of the last round


def prefix_length(n: int, percent: int) -> int:
    """Of a set of n members, that many first ones hold a member of every set that is similar enough."""
    return n - -(-n * percent // 100) + 1


def parities(h: np.ndarray) -> bytes:
    """A bit for each part of the hash range, whether it holds an odd number of members: about one part for two members."""
    least, most = PARTS
    parts = min(most, max(least, 1 << (max(len(h) - 1, 0) // 2).bit_length()))
    return np.packbits(np.bincount((h & U(parts - 1)).astype(np.int64), minlength=parts) % 2 == 1).tobytes()


def by_size(sigs: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size of parities: where each row's are, and those of all rows of that size or more, folded to it.

    Parts are told apart by the last bits of a hash, so the two halves laid over each other are the parities of half as many parts.
    """
    sizes = np.array([len(x) for x in sigs])
    levels = sorted({*sizes.tolist()}, reverse=True)
    found, rows, words = {}, np.zeros(0, np.int64), np.zeros((0, levels[0] // 8), np.uint64)
    for size in levels:
        while words.shape[1] > size // 8:
            half = words.shape[1] // 2
            words = words[:, :half] ^ words[:, half:]
        own = np.flatnonzero(sizes == size)
        rows = np.concatenate([rows, own])
        words = np.concatenate([words, np.frombuffer(b"".join(sigs[k] for k in own), np.uint64).reshape(len(own), -1)])
        at = np.full(len(sigs), -1)
        at[rows] = np.arange(len(rows))
        found[size] = at, words
    return found


def parts_apart(rows: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many parts of the hash range the rows of each pair differ: at most as many as there are members of one set alone."""
    out, least = np.zeros(len(i), np.int64), np.minimum(rows["size"][i], rows["size"][j])
    for size, (at, words) in rows["sig"].items():
        k = np.flatnonzero(least == size)
        out[k] = np.bitwise_count(words[at[i[k]]] ^ words[at[j[k]]]).sum(1, dtype=np.int64)
    return out


def sketch(df: DataFrame, text: str, percent: int, width: int) -> DataFrame:
    """Add a struct: fingerprint and size of the set, the members that can be in its prefix, and its parities by hash range."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                h = shingles(lower_words(t), width)
                # those not counted come by hash, so no more of them are needed than the prefix holds
                low = h[: int(np.searchsorted(h, U(COUNTED))) + prefix_length(len(h), percent)].view(np.int64) if len(h) else None
                rows.append((xxhash.xxh3_128_digest(h.tobytes()), len(h), low, parities(h)))
            yield pd.DataFrame(rows, columns=["fp", "n", "low", "sig"])
        minhash._hashes.clear()

    made = F.pandas_udf(run, "fp binary, n long, low array<long>, sig binary")
    return ready_for_python(df).withColumn("_sketch", made(F.col(f"`{text}`")))


def classes(sketched: DataFrame) -> np.ndarray:
    """How often counted n-grams occur, as powers of two by slots of their hashes: of those that share a slot, the most frequent one's.

    An order needs no more than one number for each n-gram.  Collisions only move some rare ones back; the size is fixed, whatever the corpus.
    """
    members = sketched.select(F.explode("low").alias("h")).filter(f"h between 0 and {COUNTED - 1}")
    counts = members.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    slot = F.col("h").bitwiseAND(F.lit(SLOTS - 1))
    slots = counts.select((slot / PAGE).cast("int").alias("page"), (slot % PAGE).cast("int").alias("at"), F.floor(F.log2("c")).cast("byte").alias("k"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:  # a page has PAGE rows at most
        out = np.zeros(PAGE, np.uint8)
        out[rows["at"].to_numpy()] = rows["k"].to_numpy()
        return pd.DataFrame({"page": [int(rows["page"].iloc[0])], "data": [out.tobytes()]})

    largest = slots.groupBy("page", "at").agg(F.max("k").alias("k"))
    table = np.zeros(max(SLOTS, PAGE), np.uint8)
    for row in largest.groupBy("page").applyInPandas(packed, "page int, data binary").toLocalIterator():  # a byte per slot
        table[row["page"] * PAGE : (row["page"] + 1) * PAGE] = np.frombuffer(row["data"], np.uint8)
    return table


def with_prefix(sketched: DataFrame, percent: int) -> DataFrame:
    """In place of the members that can be: places and hashes of the first ones in the common order that another text may share.

    A counted n-gram whose slot holds no count occurs in one text alone and joins nothing.
    """
    shared = sketched.sparkSession.sparkContext.broadcast(classes(sketched))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        often = shared.value
        for lows, sizes in batches:
            out = []
            for low, n in zip(lows, sizes, strict=True):
                counted = int(np.searchsorted(low.view(U), U(COUNTED)))
                order = np.zeros(len(low), np.uint8)
                order[:counted] = often[low[:counted] & (SLOTS - 1)]
                # by count, then by hash, of which they are in order already
                first = np.argsort(order, kind="stable")[: prefix_length(n, percent)]
                places = np.flatnonzero((order[first] > 0) | (first >= counted))
                out.append((places.astype(np.int32), low[first[places]]))
            yield pd.DataFrame(out, columns=["pos", "token"])

    return sketched.withColumn("prefix", F.pandas_udf(run, "pos array<int>, token array<long>")("low", "n")).drop("low")


def passing(rows: dict, ends: np.ndarray, percent: int, asked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pairs within a group that ``asked`` wants, have different labels and pass all filters, and upper bounds of their common members.

    ``ends`` has the end of each row's group; rows are paired with the next one, the one after it and so on, in all groups at once.
    """
    n, pos, label = rows["n"], rows["pos"], rows["label"]
    out, apart, left = [], 1, np.arange(len(n))
    while len(left := left[left + apart < ends[left]]):
        i, j = left, left + apart
        apart += 1
        ok = (label[i] != label[j]) & asked(i, j)
        i, j = i[ok], j[ok]
        needed = -(-percent * (n[i] + n[j]) // (100 + percent))
        bound = np.minimum(np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]), np.minimum(n[i], n[j]))
        ok = bound >= needed
        i, j, bound, needed = i[ok], j[ok], bound[ok], needed[ok]
        bound = np.minimum(bound, (n[i] + n[j] - parts_apart(rows, i, j)) // 2)
        ok = bound >= needed
        if ok.any():
            out.append((i[ok], j[ok], bound[ok]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def by_group(frame: DataFrame, keys: list[str], of_groups) -> DataFrame:
    """Pairs (a < b) that ``of_groups`` names for whole groups, of which it gets several at once: their rows and each row's end of group.

    Rows that are ``open`` hold an n-gram (a) that ``of_groups`` is not done with.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, size = [], 0

        def pairs(last: bool) -> pd.DataFrame:
            nonlocal rest, size
            rows = pd.concat(rest, ignore_index=True)
            values = rows[keys].to_numpy()
            edges = np.array([0, *(np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1), len(rows)])
            done = len(rows) if last else int(edges[-2])  # the last group may go on
            rest, size = [rows.iloc[done:]], len(rows) - done
            g = rows.iloc[:done]
            ends = np.repeat(edges[1:], np.diff(edges))[:done]
            fields = {c: g[c].to_numpy() for c in g.columns if c != "sig"}
            if not done:
                return pd.DataFrame({"a": [], "b": []}, dtype="int64").assign(open=False)
            sigs = g["sig"].to_list()
            fields |= {"size": np.array([len(x) for x in sigs]), "sig": by_size(sigs)}
            i, j, tokens = of_groups(fields, ends)
            a, b = fields["node"][i], fields["node"][j]
            named = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, dtype="int64").drop_duplicates()
            more = pd.DataFrame({"a": np.unique(tokens), "b": 0}, dtype="int64")
            return pd.concat([named.assign(open=False), more.assign(open=True)], ignore_index=True)

        for batch in batches:
            if len(batch):
                rest.append(batch)
                size += len(batch)
                if size >= AT_ONCE:
                    yield pairs(False)
        if size:
            yield pairs(True)

    return frame.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long, open boolean").distinct()


def promising(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs that would join what the filters leave in each chunk of an n-gram's nodes: fewer than the chunk has rows.

    An n-gram is left open if it has several chunks, or if a pair was not named because others join its nodes, which verification may undo.
    """

    def of_groups(rows: dict, ends: np.ndarray):
        left, right, bound = passing(rows, ends, percent, lambda i, j: np.ones(len(i), bool))
        root: dict[tuple, tuple] = {}

        def find(x: tuple) -> tuple:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        chosen, passed_over = [], []
        for k in np.argsort(-bound / np.minimum(rows["n"][left], rows["n"][right]), kind="stable"):
            a, b = (find((int(ends[p[k]]), int(rows["label"][p[k]]))) for p in (left, right))
            if a != b:
                root[a] = b
                chosen.append(k)
            else:
                passed_over.append(k)
        tokens = np.concatenate([rows["token"][left[passed_over]], rows["token"][rows["m"] > CHUNK]])
        return left[chosen], right[chosen], tokens

    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(turn)), chunks).cast("int")
    return by_group(members.withColumn("chunk", own), ["token", "chunk"], of_groups)


def remaining(members: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components that pass the filters.  Rows are narrow until they are in their blocks."""
    # length classes are wider than similar sets are apart, so only neighbouring classes hold similar sets
    cell = F.floor(F.log(F.col("n").cast("double")) / max(0.01, 1.0001 * math.log(100 / percent))).cast("int")
    rows = written_table(members.join(described.select("node", "n"), "node").select("token", "node", "pos", "label", "main", "n", cell.alias("cell")), "open")
    outside = rows.filter("label != main").withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    keys = ["token", "cell"]
    homes = rows.groupBy(*keys).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("homes"))
    guests = outside.groupBy(*keys).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("guests"))
    blocks = written_table(homes.join(guests, keys), "blocks")
    at_home = rows.join(blocks, keys).withColumns(
        {"home": F.pmod(F.xxhash64("node"), F.col("homes")).cast("int"), "guest": F.explode(F.sequence(F.lit(0), F.col("guests") - 1)), "is_guest": F.lit(0)}
    )
    visiting = outside.join(blocks, keys).withColumns(
        {"guest": F.pmod(F.xxhash64("node"), F.col("guests")).cast("int"), "home": F.explode(F.sequence(F.lit(0), F.col("homes") - 1)), "is_guest": F.lit(1)}
    )

    def of_groups(rows: dict, ends: np.ndarray):
        guest, inner, node = rows["is_guest"] == 1, rows["label"] == rows["main"], rows["node"]

        def asked(i, j):
            # a pair of two outside rows meets twice, and counts where the smaller node is at home
            host, visitor = np.where(guest[j], i, j), np.where(guest[j], j, i)
            return (guest[i] != guest[j]) & (inner[host] | (node[host] < node[visitor]))

        left, right, _ = passing(rows, ends, percent, asked)
        return left, right, np.zeros(0, np.int64)

    placed = at_home.unionByName(visiting).drop("homes", "guests")
    return by_group(placed.join(described.select("node", "sig"), "node"), [*keys, "home", "guest"], of_groups)


def sets_of(df: DataFrame, id_col: str, text: str, wanted: DataFrame, width: int, repeated: bool) -> DataFrame:
    """(node, hashes): the full sets of the nodes, read again from the row that stands for each; only if rows are repeated it may be several."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(lower_words(t), width).view(np.int64) for t in texts])
        minhash._hashes.clear()

    texts = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_i"), F.xxhash64(f"`{text}`").alias("hashed"), F.col(f"`{text}`").alias("_text"))
    chosen = join_checked(texts, wanted, ["_i", "hashed"])
    sets = ready_for_python(chosen).select("node", F.pandas_udf(run, "array<long>")("_text").alias("hashes"))
    return written_table(sets.dropDuplicates(["node"]) if repeated else sets, "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach ``percent`` of their union."""
    right = join_checked(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), pairs, "b", max_bytes=BROADCAST)
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).join(pairs.select("a").distinct(), "a", "left_semi")
    both = right.join(F.broadcast(left), "a") if fits_broadcast(left, max_bytes=BROADCAST) else spread_join(right, left, frequent(pairs, "a"), "a", F.col("b"))
    common = F.size(F.array_intersect("x", "y"))
    enough = common * 100 >= (F.size("x") + F.size("y") - common) * percent
    return written_table(both.filter(enough).select("a", "b"), "links")


def joined(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Per row: id, n_shingles, component_id."""
    plain = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    made = sketch(plain, "_text", percent, width).select("_id", F.xxhash64("_text").alias("hashed"), "_sketch.*")
    sketched = written_table(made, "sketches")
    filled = sketched.filter("n > 0")
    repeated = filled.groupBy("_id", "hashed").count().filter("count > 1").limit(1).count() > 0
    best = F.min(F.struct(F.col("_id").isNull().alias("absent"), "_id", "hashed")).alias("best")
    alone = with_prefix(filled, percent).groupBy("fp").agg(
        best, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sig").alias("sig")
    )
    nodes = number_rows(alone, out="node")
    key = F.coalesce(F.col("best._id").cast("string"), F.lit("")).alias("_i")

    postings = nodes.select("node", F.inline(F.arrays_zip("prefix.pos", "prefix.token")))
    tokens = postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("m"), F.min("pos").alias("first"),
        F.struct(F.min("node"), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1)))).alias("same"),
    )
    # n-grams of one text join nothing; of those with the same texts one is enough
    alike = tokens.filter("m > 1").groupBy("m", "same").agg(F.min(F.struct("first", "token")).alias("at"))
    shared = written_table(alike.select("at.token", "m"), "tokens")
    members = written_table(join_checked(postings, shared, "token", max_bytes=BROADCAST), "members")
    described = nodes.select("node", "n", "sig")

    labels, turn, total = components(members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)), 0, 0
    while turn <= ROUNDS:
        labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        counted = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
        several = counted.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main"))
        open_ = labelled.join(several.filter("labels > 1").select("token", "main"), "token")
        pairs = promising(open_.join(described, "node"), turn, percent) if turn < ROUNDS else remaining(open_, described, percent)
        found = written_table(pairs, "pairs")
        pairs = found.filter("not open").select("a", "b")
        if turn < ROUNDS:
            still = found.filter("open").select(F.col("a").alias("token"))
            members = written_table(join_checked(members, still, "token", "left_semi", max_bytes=BROADCAST), "members")
        wanted = nodes.select("node", key, "best.hashed").join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
        links = verified(pairs, sets_of(df, id_col, text, written_table(wanted, "wanted"), width, repeated), percent)
        new = links.count()
        total += new
        if new:
            labels = components(links.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
        turn = turn + 1 if new > ENOUGH * total or turn == ROUNDS else ROUNDS

    named = nodes.select("node", "fp", "copies", "best").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("best").alias("name"), F.sum("copies").alias("rows")).filter("rows > 1")
    # rows that are alone name themselves; a set may have any share of the rows
    linked = named.select("fp", "label", "copies").join(names, "label")
    by_fp = written_table(linked.select("fp", "copies", F.col("name._id").alias("name"), F.lit(True).alias("linked")), "names")
    many = by_fp.select("fp", F.ceil(F.col("copies") / SPREAD_ROWS).cast("int").alias("_parts")).filter("_parts > 1")
    result = spread_join(sketched.select("_id", "hashed", "fp", "n"), by_fp.drop("copies"), many, "fp", F.struct("_id", "hashed"), "left")
    component = F.when(F.col("linked") & (F.col("n") > 0), F.col("name")).otherwise(F.col("_id"))
    return result.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
