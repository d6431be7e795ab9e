"""Repair of conversations by their cheapest edits.

A conversation's rows are taken by turn (nulls first; rows of one turn by role, then by the SHA-256 of their text).  Each row may be
kept, given another role or deleted, and empty turns may be inserted, so that the roles' initials read ``(s?(ua)+)?``.  Of the
cheapest edit sequences the one whose initials come first in ASCII is taken.

An edit sequence weighs one integer: its cost in the high digits, below it one digit of three bits for every edit, at a fixed
place from the left and 0 after the last one.  An ordinary minimum over these integers, from the last row back to the first
through four states, so decides cost and order at once.

Rows are numbered in order over the whole table and cut into blocks of ``BLOCK``, so a conversation of any length lies in
blocks of bounded size.  A block gives, for each state before and after it, the least weight; blocks end right after
a row, so no sequence of a block is the beginning of another one from the same state, and which is less never depends on
what follows.  One light pass over the blocks of a conversation picks their states.  The last pass reads texts and
edits of a conversation in order and holds no more than a batch; the hash over a conversation needs that order.

Null ids are one conversation.  A null role or text counts as one space.  Equality of texts is equality of SHA-256.  Repeated rows are
duplicates of each other, so ties never matter.  A role that is empty or starts otherwise can only be changed or deleted.  Empty tables
give empty results.  Other columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import ready_for_python
from newsloom.operators.keys import number_rows
from newsloom.session import written_table

BLOCK = 512
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", "none"
FAULTS = (BLANK, DUPLICATE, TRUNCATED, SOUND)
INITIALS = "sua"

# States: nothing yet; after s; after u, where an a must follow; after a.  A conversation may end in the first and the last.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES = range(4)
TAIL = ("", "II", "I", "")  # inserted at the end, from each state
WANTED = ("u", "u", "a", "u")  # what can be inserted, or be a new role, in each state
LETTERS = "DIKR"  # in ASCII order; a digit is the place from 1
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
DIGIT = 3
ROLES = {"u": "user", "a": "assistant"}
NONE = -1


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns with faults put in by crc32(``conv:turn``) % 20: 0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats
    the row, 4 makes the user its speaker.  Nulls become one space, but for ids and turns outside the hash."""

    def spaced(name: str) -> F.Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced(conv), F.lit(":"), spaced(turn)).cast("binary")) % 20
    rows = df.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"), kind.alias("kind")
    )
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    text_after = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role_after = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(1), times))).select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), role_after.alias(role), text_after.alias(text)
    )


def ordered(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with their place _g in the order of the whole table, their block _b, and all that can be said of a row alone."""
    rows = df.select(
        F.to_json(F.struct(F.col(f"`{conv}`").alias("c"))).alias("_k"),
        F.col(f"`{turn}`").cast("long").alias("_t"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("_r"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("_x"),
    )
    rows = rows.withColumns(
        {
            "_h": F.unhex(F.sha2("_x", 256)),
            "_bare": ~F.col("_x").rlike(r"[^\x20\x09-\x0D]"),
            "_cut": ~F.col("_x").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
            "_u": F.monotonically_increasing_id(),  # deals equal rows, which may stand in any order, over tasks
        }
    )
    numbered = number_rows(rows, order_by=["_k", "_t", "_r", "_h", "_u"], out="_g").drop("_u")
    return numbered.withColumn("_b", F.floor((F.col("_g") - 1) / BLOCK).cast("long"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Narrow rows (_k, _b, _g, _f) with the place of their fault in FAULTS times 4, plus that of their initial (3 for others)."""
    first = rows.filter(~F.col("_bare")).groupBy("_k", "_r", "_h").agg(F.min("_g").alias("_g")).select("_g", F.lit(True).alias("_first"))
    fault = F.when(F.col("_bare"), 0).when(F.col("_first").isNull(), 1).when(F.col("_cut"), 2).otherwise(3)
    start = F.substring("_r", 1, 1)
    initial = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    narrow = rows.select("_k", "_b", "_g", "_r", "_bare", "_cut").join(first, "_g", "left")
    return narrow.select("_k", "_b", "_g", (fault * 4 + initial).alias("_f"))


@functools.lru_cache(maxsize=4096)
def block_weights(codes: str) -> tuple[list[int], list[int], list[str]]:
    """For each pair of states before and after a block, in that order: cost (NONE if it cannot be), rank among the sequences from that
    state by letters, and letters.  Codes are letters from A, one per row."""
    width = DIGIT * 2 * len(codes)  # before each row at most one insertion can pay, and a block ends with a row
    mask, top = (1 << width) - 1, width - DIGIT

    def before(letter: str, extra: int, weight: int | None) -> int | None:
        if weight is None:
            return None
        digits = (LETTERS.index(letter) + 1 << top) | ((weight & mask) >> DIGIT)
        return ((weight >> width) + COST[letter] + extra) << width | digits

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    table: list[list[int | None]] = []
    for end in STATES:
        after: list[int | None] = [0 if q == end else None for q in STATES]
        for code in reversed(codes):
            fault, initial = divmod(ord(code) - 65, 4)
            cut = int(fault == 2)
            direct = []
            for q in STATES:
                options = [before("D", 0, after[q])]
                if fault >= 2:
                    options.append(before("R", cut, after[STEP[q, WANTED[q]]]))
                    if initial < 3 and (q, INITIALS[initial]) in STEP:
                        options.append(before("K", cut, after[STEP[q, INITIALS[initial]]]))
                direct.append(least(*options))
            after = [least(direct[q], before("I", 0, direct[STEP[q, WANTED[q]]])) for q in STATES]
        table.append(after)
    costs, ranks, letters = [NONE] * 16, [NONE] * 16, [""] * 16
    for q in STATES:
        reached = sorted((table[end][q] & mask, end) for end in STATES if table[end][q] is not None)
        for rank, (digits, end) in enumerate(reached):
            costs[4 * q + end], ranks[4 * q + end] = table[end][q] >> width, rank
            places = [(digits >> shift) & 7 for shift in range(top, -1, -DIGIT)]
            letters[4 * q + end] = "".join(LETTERS[p - 1] for p in places if p)
    return costs, ranks, letters


def weighed(faults: DataFrame) -> DataFrame:
    """(_k, _b, codes, costs, ranks, letters) of every block of every conversation."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for codes in batches:
            yield pd.DataFrame([block_weights(c) for c in codes], columns=["costs", "ranks", "letters"])
        block_weights.cache_clear()

    rows = F.sort_array(F.collect_list(F.struct("_g", F.char(F.col("_f") + 65).alias("c"))))  # BLOCK rows at most
    blocks = faults.groupBy("_k", "_b").agg(F.array_join(F.transform(rows, lambda r: r["c"]), "").alias("codes"))
    weights = F.pandas_udf(run, "costs array<int>, ranks array<int>, letters array<string>")("codes")
    return blocks.withColumn("_w", weights).select("_k", "_b", "codes", "_w.*")


def chosen(blocks: DataFrame) -> DataFrame:
    """(_k, _b, _q, _e, _last): the states before and after each block on the conversation's least way."""

    def ways(key: str, seen: list[tuple]) -> list[tuple]:
        q, out = 0, []
        for number, (block, after) in enumerate(reversed(seen)):
            out.append((key, block, q, after[q], number == len(seen) - 1))
            q = after[q]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seen, cost = None, [], []  # of each block four numbers are held
        names = ["_k", "_b", "_q", "_e", "_last"]
        for batch in batches:
            out = []
            for k, b, costs, ranks in zip(batch["_k"], batch["_b"], batch["costs"], batch["ranks"], strict=True):
                if k != key:
                    out += ways(key, seen)
                    key, seen, cost = k, [], [COST["I"] * len(t) for t in TAIL]
                after = [
                    min(((costs[4 * q + e] + cost[e], ranks[4 * q + e], e) for e in STATES if costs[4 * q + e] != NONE), default=(None, 0, NONE))
                    for q in STATES
                ]
                # from every state all rows can be deleted, so there always is a way
                seen.append((b, bytes(e for _, _, e in after)))
                cost = [c for c, _, _ in after]
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(ways(key, seen), columns=names)

    light = blocks.select("_k", "_b", "costs", "ranks")
    backwards = light.repartition("_k").sortWithinPartitions("_k", F.desc("_b"))
    return backwards.mapInPandas(run, "_k string, _b long, _q int, _e int, _last boolean")


def steps(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(key, edit, state before it, fault, turn, role, text) in order, from rows sorted by conversation, block and place, a
    block's edits (codes and letters) before its rows."""
    key, letters, codes, at, row, q = None, "", "", 0, 0, 0

    def inserted():
        nonlocal at, q
        while at < len(letters) and letters[at] == "I":
            at += 1
            yield key, "I", q, None, None, None, None
            q = STEP[q, WANTED[q]]

    for batch in batches:
        for k, begins, given, turn, role, text in zip(batch["_k"], batch["_q"], batch["_l"], batch["_t"], batch["_r"], batch["_x"], strict=True):
            if given is not None:
                yield from inserted()
                codes, letters = given.split(",")
                key, at, row, q = k, 0, 0, int(begins)
                continue
            yield from inserted()
            edit, fault = letters[at], FAULTS[(ord(codes[row]) - 65) // 4]
            yield k, edit, q, fault, None if pd.isna(turn) else int(turn), role, text
            at, row = at + 1, row + 1
            if edit != "D":
                q = STEP[q, role[:1] if edit == "K" else WANTED[q]]
    yield from inserted()


def in_order(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows and block edits of each conversation together, as ``steps`` reads them."""
    rows = ordered(ready_for_python(df), conv, turn, role, text)
    blocks = written_table(weighed(with_faults(rows)), "blocks")
    way = blocks.join(chosen(blocks), ["_k", "_b"])
    letters = F.concat(
        "codes", F.lit(","), F.element_at("letters", F.col("_q") * 4 + F.col("_e") + 1),
        F.when(F.col("_last"), F.element_at(F.array(*[F.lit(t) for t in TAIL]), F.col("_e") + 1)).otherwise(""),
    )
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("_t", "long"), ("_r", "string"), ("_x", "string"))]
    edits = way.select("_k", "_b", F.lit(-1).cast("long").alias("_g"), "_q", letters.alias("_l"), *empty)
    plain = rows.select("_k", "_b", "_g", F.lit(None).cast("int").alias("_q"), F.lit(None).cast("string").alias("_l"), "_t", "_r", "_x")
    both = edits.unionByName(plain).repartition("_k").sortWithinPartitions("_k", "_b", "_g")
    return both.select("_k", "_q", "_l", "_t", "_r", "_x")


def after_edit(edit: str, q: int, role: str | None, text: str | None) -> tuple[str, str]:
    """Role and text that an edit leaves; not for deletions."""
    return (role, text) if edit == "K" else (ROLES[WANTED[q]], text or "")


def edits(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The edit script: _k (the id as JSON), at (from 0), edit (K, R, D or I), fault, turn, role and text after the edit (null if deleted)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, key, at = [], None, 0
        for k, edit, q, fault, t, r, x in steps(batches):
            key, at = k, at + 1 if k == key else 0
            out.append((k, at, edit, fault, t, *((None, None) if edit == "D" else after_edit(edit, q, r, x))))
            if len(out) == 1000:
                yield frame(out)
                out = []
        yield frame(out)

    def frame(out: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(out, columns=["_k", "at", "edit", "fault", "turn", "role", "text"])
        return made.astype({"turn": "Int64", "at": "int64"})

    return in_order(df, conv, turn, role, text).mapInPandas(run, "_k string, at long, edit string, fault string, turn long, role string, text string")


class Summary:
    """Counts, cost, audit and hash of one conversation, row by row."""

    def __init__(self):
        self.turns, self.low, self.high = 0, None, None
        self.faults = dict.fromkeys(FAULTS, 0)
        self.illegal, self.cost, self.last, self.audit = 0, 0, None, []
        self.hash, self.written = hashlib.sha256(), False

    def add(self, edit, q, fault, turn, role, text) -> None:
        self.audit.append(edit)
        self.cost += COST[edit] + (fault == TRUNCATED and edit != "D")
        if edit != "I":
            self.faults[fault] += 1
            if turn is not None and turn != self.high:
                self.turns, self.high = self.turns + 1, turn
                self.low = turn if self.low is None else self.low
            if self.last is not None:
                self.illegal += self.last + role[:1] not in ("su", "ua", "au")
            self.last = role[:1]
        if edit != "D":
            role, text = after_edit(edit, q, role, text)
            self.hash.update(("\n" * self.written + f"{role}:{text}").encode())
            self.written = True

    def row(self, key: str) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        f = self.faults
        return key, gaps, f[BLANK], f[DUPLICATE], f[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def summary(df: DataFrame, all_of: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation of ``all_of``: faults of the rows that ``df`` holds of it, cost and initials of its edits, hash of what they leave."""
    names = ["_k", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, key, now = [], None, None
        for k, *step in steps(batches):
            if k != key:
                if now is not None:
                    out.append(now.row(key))
                key, now = k, Summary()
                if len(out) == 1000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            now.add(*step)
        if now is not None:
            out.append(now.row(key))
        yield pd.DataFrame(out, columns=names)

    schema = "_k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    found = in_order(df, conv, turn, role, text).mapInPandas(run, schema)
    whole = all_of.select(F.col(f"`{conv}`").alias(conv)).distinct().withColumn("_k", F.to_json(F.struct(F.col(f"`{conv}`").alias("c"))))
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names[1:7]]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.join(found, "_k", "left").select(
        F.col(f"`{conv}`"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )
