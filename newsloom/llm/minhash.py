"""Near duplicates by HyperMinHash.

Each text's shingles are hashed; the first bits of a hash choose a register, which keeps the smallest rest
as a count of leading zeros and some mantissa bits.  Registers are compared in bands of four.  Texts that
share a band are compared by registers (corrected for registers that agree by chance) and what may
reach the threshold is confirmed on the full shingle sets.

Equal word sequences are one node throughout, so copies cost one row each.  Buckets with the same members
are taken once.  A first round compares every node with the smallest node of each of its buckets, each such pair once.  Only buckets whose
nodes are then still in several components go on, and only there do registers travel with the rows: a second round cuts them into
small chunks and confirms a spanning forest of each; in the third, members outside the bucket's main component meet all members, both
cut into blocks, so a task holds two blocks of bounded size at a time, and every plausible pair of different components is confirmed:
what stays apart was compared.  Components grow by stars; nothing is collected.

Members of sets are 64-bit hashes: two different shingles of a pair of texts are taken for one with probability below 1e-13 for texts of a
thousand words.  Equal word sequences and buckets with the same members are recognised by 128 bits.

A text without words is linked with nothing and is its own component.  A row without id can be linked, and
its component is named by the smallest id in it (null if there is none).  Rows that share an id are judged
by their own texts.  ``keep_one`` keeps exactly one row of each component, also where ids are null or repeated, and every row
without words; other columns pass through it.  Texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import lower_words, ready_for_python
from newsloom.operators.joins import fits_broadcast, frequent, join_checked, spread_join
from newsloom.operators.keys import number_rows
from newsloom.session import written_table

WIDTH = 5
REGISTER_BITS = 7
REGISTERS = 1 << REGISTER_BITS
REST_BITS = 64 - REGISTER_BITS
MANTISSA_BITS = 10
BAND = 4  # registers of 16 bits: a band is one long
CHUNK = 64  # nodes of a bucket that are compared with each other at once
LATER_CHUNK = 1024  # the same where most are in one component already, so few pairs are open
SLACK = 6  # a pair at the threshold is that far below it with probability 1e-8 at 128 registers
PROBES = 512
CACHED_WORDS = 100_000
U = np.uint64

_mixer = np.random.RandomState(20240229)
# where an empty register looks for a filled one; the same for all texts
_probe = _mixer.randint(0, REGISTERS, (PROBES, REGISTERS))
_hashes: dict[bytes, int] = {}


def word_hashes(found: list[bytes]) -> np.ndarray:
    known = _hashes
    if len(known) > CACHED_WORDS:
        known.clear()
    out = []
    for w in found:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, U)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def shingles(found: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of fewer words, the whole sequence is one shingle."""
    if not found:
        return np.zeros(0, U)
    h = word_hashes(found)
    width = min(width, len(h))
    total = np.zeros(len(h) - width + 1, U)
    for k in range(width):
        total = total * U(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    return np.unique(mixed(total + U(width)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 16-bit registers of a set; empty ones take over the register a fixed sequence leads to."""
    bucket = (hashes >> U(REST_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # hashes are sorted: the smallest of each bucket
    rest = hashes[first] & U((1 << REST_BITS) - 1)
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    zeros = np.clip(REST_BITS - bits, 0, REST_BITS)
    mantissa = ((rest << (zeros + 1).astype(U)) & U((1 << REST_BITS) - 1)) >> U(REST_BITS - MANTISSA_BITS)
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[first]] = ((zeros + 1) << MANTISSA_BITS | mantissa.astype(np.int64)).astype(np.uint16)
    filled = out.copy()
    empty = np.flatnonzero(out == 0)
    for row in _probe:
        if len(empty) == 0:
            break
        found = filled[row[empty]]
        out[empty] = found
        empty = empty[found == 0]
    if len(empty):
        out[empty] = filled[bucket[first[0]]]
    return out


def collision_rate() -> float:
    """How often the registers of unlike sets agree: the chance that two minima have equal zeros and mantissa.

    For minima of like sized sets each doubling of the leading zeros halves the chance to be there, and within
    one count the mantissa is nearly even: sum over z of 4^-z, spread over the mantissa values.
    """
    return (1 / 3) / (1 << MANTISSA_BITS)


def estimates(packed: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of all pairs in a chunk (rows of packed registers)."""
    r = np.ascontiguousarray(packed.astype(np.int64)).view(np.uint16)
    agree = np.empty((len(r), len(r)))
    for i in range(len(r)):
        agree[i] = (r == r[i]).mean(1)
    e = collision_rate()
    return (agree - e) / (1 - e)


def plausible(packed: np.ndarray, sizes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs may reach the threshold (SLACK deviations of the estimate below it still may), and the estimates."""
    est = estimates(packed)
    least, most = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    slack = SLACK * np.sqrt(threshold * (1 - threshold) / np.minimum(least, REGISTERS))
    return (est >= threshold - slack) & (least >= threshold * most), est


def plausible_with(packed: np.ndarray, sizes: np.ndarray, i: int, others: np.ndarray, threshold: float) -> np.ndarray:
    """``plausible`` of one row with some others."""
    r = np.ascontiguousarray(packed).view(np.uint16)
    agree, e = (r[others] == r[i]).mean(1), collision_rate()
    slack = SLACK * np.sqrt(threshold * (1 - threshold) / np.minimum(np.minimum(sizes[others], sizes[i]), REGISTERS))
    return (agree - e) / (1 - e) >= threshold - slack


def forest(ok: np.ndarray, est: np.ndarray, pivot: int) -> list[tuple[int, int]]:
    """Pairs that span what is plausible: with the pivot first, then by estimate."""
    n = len(ok)
    near = ok[pivot].copy()
    near[pivot] = True
    out = [(pivot, int(i)) for i in np.flatnonzero(near) if i != pivot]
    root = np.where(near, pivot, np.arange(n))
    if near.all():
        return out
    left, right = np.nonzero(np.triu(ok, 1) & ~(near[:, None] & near[None, :]))
    for k in np.argsort(-est[left, right], kind="stable"):
        a, b = root[left[k]], root[right[k]]
        if a != b:
            out.append((int(left[k]), int(right[k])))
            root[root == b] = a
    return out


def sketch(df: DataFrame, text: str, out: str = "_sketch") -> DataFrame:
    """Add a struct: fingerprint of the word sequence, size of the shingle set, registers four to a long."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                found = lower_words(t)
                hashes = shingles(found)
                packed = registers(hashes).view(np.int64) if len(hashes) else None
                rows.append((xxhash.xxh3_128_digest(b" ".join(found)), len(hashes), packed))
            yield pd.DataFrame(rows, columns=["fp", "n", "regs"])
        _hashes.clear()  # workers live on, with other operators' tables beside this one

    return ready_for_python(df).withColumn(out, F.pandas_udf(run, "fp binary, n long, regs array<long>")(F.col(f"`{text}`")))


def sets_of(df: DataFrame, text: str) -> DataFrame:
    """(fp, n, hashes) of the full shingle sets."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                found = lower_words(t)
                rows.append((xxhash.xxh3_128_digest(b" ".join(found)), shingles(found).view(np.int64)))
            yield pd.DataFrame(rows, columns=["fp", "hashes"])
        _hashes.clear()

    # marked so that no filter on the result moves below the join that chose the rows, where it would read all texts
    hashed = F.pandas_udf(run, "fp binary, hashes array<long>").asNondeterministic()
    made = ready_for_python(df).select(hashed(F.col(text)).alias("_s"))
    return made.select("_s.fp", "_s.hashes")


def in_buckets(reps: DataFrame) -> DataFrame:
    """(node, band, key) for each bucket a node is in with others, with the bucket's size and smallest node.

    Nearly all buckets have one member, so counting before the shuffle would save nothing and make its rows twice as wide.  Rows are dealt out
    by bucket once, bare; the counts and the join with them both start from there.
    """
    members = reps.select("node", F.posexplode("regs").alias("band", "key")).filter("key is not null").repartition("band", "key")
    buckets = members.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("m"), F.min("node").alias("pivot"),
        F.struct(F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1)))).alias("same"),
    )
    # buckets of one member link nothing; of those with the same members that of the first band is enough
    alike = buckets.filter(F.col("m") > 1).groupBy("m", "pivot", "same").agg(F.min(F.struct("band", "key")).alias("at"))
    return members.join(alike.select("at.band", "at.key", "m", "pivot"), ["band", "key"])


GROUP = ["band", "key", "chunk"]
BLOCKS = ["band", "key", "home", "guest"]


def by_group(frame: DataFrame, group: list[str], of_group, schema: str) -> DataFrame:
    """``of_group`` over the rows of each group; rows come sorted, so a group ends where its key changes."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            if len(batch) == 0:
                continue
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rows[group].to_numpy()
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()]
            out = [r for a, b in zip(edges, edges[1:], strict=False) for r in of_group(rows.iloc[a:b])]
            rest = rows.iloc[edges[-1] :]
            yield pd.DataFrame(out, columns=names, dtype="int64")
        if rest is not None:
            yield pd.DataFrame(of_group(rest), columns=names, dtype="int64")

    return frame.repartition(*group).sortWithinPartitions(*group).mapInPandas(run, schema)


def pivot_pairs(members: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Plausible pairs (a < b) of the nodes with the smallest node of each of their buckets, each pair once.

    A node may be the smallest of buckets with any share of the rows: its registers are broadcast while those of all such nodes are few."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for x, n, y, m in batches:
            if len(x) == 0:
                yield pd.Series([], dtype=bool)
                continue
            left, right = (np.stack(c.to_list()).astype(np.int64).view(np.uint16) for c in (x, y))
            agree, e = (left == right).mean(1), collision_rate()
            sizes = np.stack([n.to_numpy(np.float64), m.to_numpy(np.float64)])
            least, most = sizes.min(0), sizes.max(0)
            slack = SLACK * np.sqrt(threshold * (1 - threshold) / np.minimum(least, REGISTERS))
            yield pd.Series(((agree - e) / (1 - e) >= threshold - slack) & (least >= threshold * most))

    pairs = written_table(members.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    of_b = reps.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("regs").alias("y"))
    of_b = join_checked(of_b, pairs, "b")  # pairs are narrow, registers need not move
    pivots = reps.select(F.col("node").alias("a"), "n", F.col("regs").alias("x")).join(pairs.select("a").distinct(), "a", "left_semi")
    if fits_broadcast(pivots):
        both = of_b.join(F.broadcast(pivots), "a")
    else:
        both = spread_join(of_b, pivots, frequent(pairs, "a"), "a", F.col("b"))
    return both.filter(F.pandas_udf(run, "boolean")("x", "n", "y", "m")).select("a", "b")


def forest_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a < b) that span what is plausible between components in each chunk: fewer than the chunk has rows."""

    def of_group(g: pd.DataFrame) -> list[tuple]:
        node, label = g["node"].to_numpy(), g["label"].to_numpy()
        if len(node) < 2 or (label == label[0]).all():
            return []
        ok, est = plausible(np.stack(g["regs"].to_list()), g["n"].to_numpy().astype(np.float64), threshold)
        ok &= label[:, None] != label[None, :]
        pairs = forest(ok, est, int(np.argmin(node)))
        return [(min(node[i], node[j]), max(node[i], node[j])) for i, j in pairs if node[i] != node[j]]

    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    return by_group(members.withColumn("chunk", F.pmod(F.xxhash64("node", "band"), chunks).cast("int")), GROUP, of_group, "a long, b long").distinct()


def open_pairs(g: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the plausible pairs of different components, the first one at home in the block, the second a guest.

    Two rows outside the main component meet twice, and count where the smaller node is at home.  A pair counts in the first band it
    shares only; the bucket of that band was kept, as of buckets with the same members the one of the first band is.
    """
    packed = np.stack(g["regs"].to_list()).astype(np.int64)
    guest, label, band = g["guest_row"].to_numpy().astype(bool), g["label"].to_numpy(), int(g["band"].iloc[0])
    node, sizes, main = g["node"].to_numpy(), g["n"].to_numpy().astype(np.float64), g["main"].iloc[0]
    guests = np.flatnonzero(guest)
    left, right = [], []
    for i in np.flatnonzero(~guest):
        others = guests[(label[guests] != label[i]) & (np.minimum(sizes[guests], sizes[i]) >= threshold * np.maximum(sizes[guests], sizes[i]))]
        if label[i] != main:
            others = others[node[others] > node[i]]
        others = others[np.argmax(packed[others] == packed[i], axis=1) == band] if len(others) else others
        if len(others):
            ok = plausible_with(packed, sizes, int(i), others, threshold)
            left += [i] * int(ok.sum())
            right += others[ok].tolist()
    return np.array(left, int), np.array(right, int)


def last_links(members: DataFrame, reps: DataFrame, df: DataFrame, id_col: str, text: str, percent: int, repeated: bool) -> DataFrame:
    """Confirmed pairs that join different components.  Blocks first name the rows that take part in a plausible pair; full sets
    are sent for those alone and compared inside the block, which hands on the pairs that join something."""
    threshold = percent / 100

    def taking_part(g: pd.DataFrame) -> list[tuple]:
        if g["guest_row"].nunique() < 2:
            return []
        left, right = open_pairs(g, threshold)
        key = tuple(int(g[c].iloc[0]) for c in BLOCKS)
        return [(*key, int(g["node"].iloc[i]), int(g["guest_row"].iloc[i])) for i in sorted({*left.tolist(), *right.tolist()})]

    placed = ", ".join(f"{c} long" for c in BLOCKS)
    part = written_table(by_group(members, BLOCKS, taking_part, f"{placed}, node long, guest_row long"), "partners")
    sets = sets_for(part.select("node").distinct(), reps, df, id_col, text, repeated)
    rows = members.join(part, [*BLOCKS, "node", "guest_row"]).join(sets, "node")

    def of_group(g: pd.DataFrame) -> list[tuple]:
        if g["guest_row"].nunique() < 2:
            return []
        node, label = g["node"].to_numpy(), g["label"].to_numpy().copy()
        hashes = [np.asarray(h).view(U) for h in g["hashes"]]
        out = []
        for i, j in zip(*open_pairs(g, threshold), strict=True):
            if label[i] == label[j]:
                continue
            common = int(np.isin(hashes[i], hashes[j], assume_unique=True).sum())
            if 100 * common >= percent * (len(hashes[i]) + len(hashes[j]) - common):
                out.append((min(node[i], node[j]), max(node[i], node[j])))
                label[label == label[j]] = label[i]
        return out

    return written_table(by_group(rows, BLOCKS, of_group, "a long, b long").distinct(), "links")


def in_blocks(members: DataFrame, size: int) -> DataFrame:
    """Rows of each bucket at home in one block, beside every block of guests; and those outside the main component as guests beside every block
    of homes.  Blocks hold about ``size`` rows, whatever the bucket does."""
    outside = F.col("label") != F.col("main")
    keys = ["band", "key"]
    sizes = members.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / size).cast("int").alias("homes"), F.ceil(F.count(F.when(outside, 1)) / size).cast("int").alias("guests")
    )
    placed = members.join(sizes, keys)
    at_home = placed.withColumns(
        {"home": F.pmod(F.xxhash64("node", "band"), F.col("homes")).cast("int"), "guest": F.explode(F.sequence(F.lit(0), F.col("guests") - 1)), "guest_row": F.lit(0)}
    )
    visiting = placed.filter(outside).withColumns(
        {"guest": F.pmod(F.xxhash64("node", "band"), F.col("guests")).cast("int"), "home": F.explode(F.sequence(F.lit(0), F.col("homes") - 1)), "guest_row": F.lit(1)}
    )
    return at_home.unionByName(visiting).drop("homes", "guests")


def sets_for(nodes: DataFrame, reps: DataFrame, df: DataFrame, id_col: str, text: str, repeated: bool) -> DataFrame:
    """(node, hashes) of the full shingle sets.  Texts are read again for these nodes only, from the row that stands for each; only if rows are
    repeated it may be several."""
    key = F.coalesce(F.col("best._id").cast("string"), F.lit("")).alias("_i")
    wanted = written_table(nodes.join(reps.select("node", "fp", key, F.col("best.hashed").alias("hashed")), "node"), "nodes")
    texts = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("_i"), F.col(f"`{text}`").alias("_text"), F.xxhash64(f"`{text}`").alias("hashed"))
    chosen = join_checked(texts, wanted.select("_i", "hashed").distinct(), ["_i", "hashed"], "left_semi", bound=wanted.select("_i", "hashed"))
    sets = join_checked(sets_of(chosen, "_text"), wanted.select("fp", "node"), "fp")
    return written_table((sets.dropDuplicates(["node"]) if repeated else sets).select("node", "hashes"), "sets")


def confirm(pairs: DataFrame, reps: DataFrame, df: DataFrame, id_col: str, text: str, percent: int, repeated: bool) -> DataFrame:
    """The pairs whose full sets reach ``percent`` of their union."""
    pairs = written_table(pairs, "pairs")
    sets = sets_for(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), reps, df, id_col, text, repeated)
    # pairs are narrow, and the nodes on their left are the smallest of buckets, so few
    right = join_checked(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), pairs, "b")
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")).join(pairs.select("a").distinct(), "a", "left_semi")
    if fits_broadcast(left):
        both = right.join(F.broadcast(left), "a")
    else:
        both = spread_join(right, left, frequent(pairs, "a"), "a", F.col("b"))
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return written_table(both.filter(common * 100 >= union * percent).select("a", "b"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component, by alternating large and small stars."""
    pairs = written_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "stars")
    state = None
    while True:
        now = tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state or now[0] == 0:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = now
        both = pairs.union(pairs.select("v", "u"))
        least = written_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written_table(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # few rows a node by now: the large star moved its neighbours
        joined = large.join(least, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = written_table(small.distinct(), "stars")


def as_links(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("a"), F.col("label").alias("b"))


def parted(members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with their label, that of the largest one there (main), size and registers."""
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counted = labelled.groupBy("band", "key", "label").agg(F.count(F.lit(1)).alias("c"))
    several = (
        counted.groupBy("band", "key").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("main"))
        .filter(F.col("labels") > 1).drop("labels")
    )
    left = written_table(labelled.join(several, ["band", "key"]), "left")
    # few nodes are left: their registers are looked for once, and only they move
    chosen = join_checked(reps.select("node", "n", "regs"), left.select("node").distinct(), "node", "left_semi")
    return left.join(written_table(chosen, "registers"), "node")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept (whether the row has the id that names its component)."""
    return judged(df, id_col, text, percent).select(
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def judged(df: DataFrame, id_col: str, text: str, percent: int) -> DataFrame:
    """Per row: _id, hashed text, n, component_id, and first: whether it has the least id of its component, and of the rows with that id the least hash."""
    threshold = percent / 100
    sketched = written_table(
        sketch(df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text")), "_text").select(
            "_id", F.xxhash64("_text").alias("hashed"), "_sketch.fp", "_sketch.n", "_sketch.regs"
        ),
        "sketches",
    )
    grouped = (
        sketched.filter(F.col("n") > 0)
        .groupBy("fp")
        .agg(F.min(F.struct(F.col("_id").isNull().alias("absent"), "_id", "hashed")).alias("best"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    )
    rows_of = sketched.filter(F.col("n") > 0).groupBy(F.coalesce(F.col("_id").cast("string"), F.lit("")), "hashed").count()
    repeated = rows_of.filter("count > 1").limit(1).count() > 0
    reps = number_rows(grouped, out="node")
    inside = written_table(in_buckets(reps), "members")
    links = confirm(pivot_pairs(inside, reps, threshold), reps, df, id_col, text, percent, repeated)
    labels = components(links)
    left = parted(inside, labels, reps)
    if left.limit(1).count():
        links = confirm(forest_pairs(left, threshold), reps, df, id_col, text, percent, repeated)
        labels = components(as_links(labels).union(links))
        left = parted(inside, labels, reps)
        links = last_links(in_blocks(left, LATER_CHUNK), reps, df, id_col, text, percent, repeated)
        labels = components(as_links(labels).union(links)) if links.limit(1).count() else labels

    named = reps.select("node", "fp", "best").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = written_table(named.groupBy("label").agg(F.min("best").alias("best")), "names")
    by_fp = written_table(named.select("fp", "label").join(names, "label").select("fp", "best"), "components")
    joined = sketched.select("_id", "hashed", "fp", "n").join(by_fp, "fp", "left")
    bare = F.col("n") == 0
    first = bare | F.col("_id").eqNullSafe(F.col("best._id")) & (F.col("hashed") == F.col("best.hashed"))
    return joined.select("_id", "hashed", "n", F.when(bare, F.col("_id")).otherwise(F.col("best._id")).alias("component_id"), first.alias("first"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``df`` that stay when each component keeps one: its row of the smallest id.

    Rows with the same id and text are judged alike, so rows are removed by both; of several that should stay one does."""

    def keyed(frame: DataFrame, name: str, hashed) -> DataFrame:
        return frame.withColumns({"_absent": F.col(name).isNull(), "_gone": F.coalesce(F.col(name).cast("string"), F.lit("")), "_hashed": hashed})

    on = ["_absent", "_gone", "_hashed"]
    rows = keyed(judged(df, id_col, text, percent).filter(F.col("n") > 0), "_id", F.col("hashed"))
    counted = rows.groupBy(*on).agg(F.max("first").alias("first"), F.count(F.lit(1)).alias("c"))
    marked = written_table(counted.filter(~F.col("first") | (F.col("c") > 1)), "gone")
    gone, several = marked.filter(~F.col("first")).select(*on), marked.filter("first").select(*on)
    left = join_checked(keyed(df, f"`{id_col}`", F.xxhash64(f"`{text}`")), gone, on, "left_anti", bound=marked)
    if several.limit(1).count():
        one = join_checked(left, several, on, "left_semi", bound=marked).dropDuplicates(on)
        left = join_checked(left, several, on, "left_anti", bound=marked).unionByName(one)
    return left.select(*[F.col(f"`{c}`") for c in df.columns])
