"""Secret scans: fixed patterns, and strings that stay incompressible next to what surrounds them.

A candidate is a long run of key characters with a sensitive word shortly before it, or one that goes on from such a run
or a fixed pattern after only line breaks, dots, quotes or the like: all lines of a key block, all parts of a dotted token;
also the short last line of a block.  zstandard is primed
with a dictionary of common identifiers and the text around the candidate; the bytes it then needs for
the candidate are its novelty.  Names, paths and words share pieces with their surroundings and cost
little; keys cost what random characters of their alphabet cost at their length, and are reported.  Copies of the candidate
nearby do not prime; once a string is reported, so are all its copies in the text, whatever stands before them.

A null or empty text has no spans.  Texts are scanned whole, in code points.  Repeated rows are scanned
singly; columns other than the text pass through, but one named ``secrets`` is replaced.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import ready_for_python

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run is taken whole or, if shorter, not at all
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
LEAST = 16  # characters of a candidate
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
SENSITIVE = re.compile(
    r"key|token|secret|passw|passphrase|pwd|auth|bearer|credential|private|signature|session|cookie|cert|webhook", re.IGNORECASE | re.ASCII
)
NAMED = re.compile(rf"[A-Za-z0-9_-]+=(?=[A-Za-z0-9+/_-]{{{LEAST}}})")  # a name inside the run, before the candidate itself
GOES_ON = re.compile(r"[\s\"'`.,+\\>#*|]*[\n\r\"'`.\\][\s\"'`.,+\\>#*|]*")
LAST_LINE = re.compile(r"\r?\n[\x20\t]*([A-Za-z0-9+/]{1,15}={0,2})(?=[\x20\t]*(?:\r?\n[\x20\t]*-----END|(?<==)[\x20\t]*(?:[\r\n]|\Z)))")
IDENTIFIERS = (
    "accessKey access_token apiKey api_key application arguments array assert async attribute authorization await base64 "
    "boolean buffer callback certificate class client_id client_secret collection column configuration connection const "
    "container context controller credentials customer database datetime default description dictionary directory "
    "document element encoding endpoint environment exception expression extends false function getElementById handler "
    "headers hostname implements import index initialize instance integer interface iterator javascript length library "
    "license localhost location manager message metadata method module namespace number object operator optional "
    "package parameter password password_hash path pattern permission placeholder private_key process production "
    "properties protected protocol public_key query reference register repository request resource response return "
    "schema script secret_key security select self sequence serializer server service session_id signature static "
    "status string structure subscription super template testing thread timeout timestamp token transaction true "
    "undefined update username utf-8 validate value variable version void webhook_url with www.example.com http:// https:// "
    "0123456789abcdef 0123456789 ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz"
).encode()


@dataclass(frozen=True)
class Novelty:
    """``share``: compressed bytes per byte from which on a candidate counts as incompressible, less where random characters
    of its length and alphabet cost less: then ``near`` of their cost;
    ``context`` characters before it, or before the run it goes on from, must hold a sensitive word; ``around`` characters on either side prime
    the compressor."""

    share: float = 0.8
    near: float = 0.94
    context: int = 48
    around: int = 1000
    level: int = 3


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the fixed patterns."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def mixed_characters(candidate: str) -> bool:
    """Whether it can be a key: digits beside letters, or a case that changes within; plain words are not."""
    letters = re.sub(r"[^A-Za-z]", "", candidate)
    if letters and re.search(r"\d", candidate):
        return True
    return len(re.findall(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])", letters)) >= 4


def novelty(candidate: str, around: str, level: int) -> float:
    """Compressed bytes per byte of a candidate, after what stands around it."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_dict_id=False)
    data = candidate.encode()
    return (len(packer.compress(data)) - len(packer.compress(b""))) / len(data)


def least_cost(candidate: str, rule: Novelty) -> float:
    """Compressed bytes per byte from which on the candidate is as good as random.  Entropy-coded literals cost the entropy of
    the character set, and a table of about 10 bytes and 0.45 a character of the set (measured)."""
    kinds = len(set(candidate))
    return min(rule.share, rule.near * (math.log2(max(kinds, 2)) / 8 + (10 + 0.45 * kinds) / len(candidate)))


def surroundings(text: str, start: int, end: int, rule: Novelty) -> str:
    """What stands around a candidate, less other copies of it, also those that reach out of the window."""
    size, parts = end - start, []
    for low, high in ((max(0, start - rule.around), start), (end, min(len(text), end + rule.around))):
        # a copy that is cut by the window's outer edge lies whole in here
        first, last = (max(0, low - size), high) if high == start else (low, min(len(text), high + size))
        keep, at = [], low
        near = text[first:last]
        copy = near.find(text[start:end])
        while copy >= 0:
            keep.append(text[at : max(at, min(first + copy, high))])
            at = max(at, min(first + copy + size, high))
            copy = near.find(text[start:end], copy + size)
        parts.append(" ".join([*keep, text[at:high]]))
    return "".join(parts)


def copies(text: str, strings: set[str], taken: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans of all copies of the strings inside candidates, but for those within taken ones (in order, by start)."""
    by_start: dict[str, list[str]] = {}
    for x in sorted(strings, key=len, reverse=True):
        by_start.setdefault(x[:LEAST], []).append(x)
    found, t, reach = [], 0, 0
    for m in CANDIDATE.finditer(text) if strings else ():
        at = m.start()
        while at + LEAST <= m.end():
            hit = next((x for x in by_start.get(text[at : at + LEAST], ()) if text.startswith(x, at)), None)
            if hit is None:
                at += 1
                continue
            end = at + len(hit)
            while t < len(taken) and taken[t][0] <= at:
                reach = max(reach, taken[t][2])
                t += 1
            if reach < end:
                found.append((at, 3, end, at))
            at = end
    return found


def uncovered(start: int, end: int, met: list[tuple[int, int, int, int]]) -> int:
    """Characters from start to end outside the spans (by start)."""
    free, at = 0, start
    for low, _, high, _ in met:
        free += max(0, min(low, end) - at)
        at = max(at, high)
    return free + max(0, end - at)


def novel_spans(text: str, base: list[tuple[int, int, int, int]], rule: Novelty) -> list[tuple[int, int, int, int]]:
    found, at, carried, reported = [], 0, -1, -1  # ends of the last run in a sensitive context, and of the last one reported
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if named := NAMED.match(text, start, end):
            start = named.end()
        while at < len(base) and base[at][2] <= start:
            at += 1
        last = at
        while last < len(base) and base[last][0] < end:
            last += 1
        met = [x for x in base[max(0, at - 2) : last] if start < x[2]]
        before = max([e for _, kind, e, _ in base[max(0, at - 2) : at] if kind < 2 and e <= start], default=-1)
        since = max(carried, before)
        goes_on = 0 <= since and start - since <= rule.context and GOES_ON.fullmatch(text, since, start)
        if goes_on or any(kind < 2 for _, kind, _, _ in met) or SENSITIVE.search(text, max(0, start - rule.context), start):
            carried = max([end, *[e for _, _, e, _ in met]])
        if carried < end or uncovered(start, end, met) < (LEAST if met else 1):
            continue
        if not mixed_characters(text[start:end]):
            continue
        if novelty(text[start:end], surroundings(text, start, end, rule), rule.level) >= least_cost(text[start:end], rule):
            found.append((start, 3, end, start))
            in_block = 0 <= reported and start - reported <= rule.context and GOES_ON.fullmatch(text, reported, start)
            if in_block and (last := LAST_LINE.match(text, end)):
                found.append((last.start(1), 3, last.end(1), last.start(1)))
            reported = end
    strings = {text[s:e] for s, _, e, _ in found if e - s >= LEAST}
    return found + copies(text, strings, sorted(base + found))


def spans(text: str | None, rule: Novelty) -> tuple[list, list]:
    """Base spans and all spans, in order of start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, rule))


def written(found: list) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in found)


def scan(df: DataFrame, text: str = "text", out: str = "secrets", rule: Novelty = Novelty()) -> DataFrame:  # noqa: B008
    """Add a struct: counts by kind, ``base`` and ``spans`` as ``kind:start:end`` joined by commas."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, every = spans(t, rule)
                kinds = [kind for _, kind, _, _ in every]
                rows.append((*map(kinds.count, range(4)), written(base), written(every)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_novel", "base", "spans"])

    kind = "n_assign long, n_access long, n_hex long, n_novel long, base string, spans string"
    return ready_for_python(df).withColumn(out, F.pandas_udf(run, kind)(F.col(f"`{text}`")))


def masked(text: str | None, rule: Novelty, mask: str) -> str | None:
    """The text with every secret replaced; where secrets overlap, their union is."""
    if not text:
        return text
    parts, at = [], 0
    for start, end in sorted((inner, end) for _, _, end, inner in spans(text, rule)[1]):
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mask]
        at = end
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]", rule: Novelty = Novelty()) -> DataFrame:  # noqa: B008
    """``df`` with all secrets in ``text`` replaced by ``mask``; the words that introduce them stay."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([masked(t, rule, mask) for t in texts], dtype=object)

    return ready_for_python(df).withColumn(text, F.pandas_udf(run, "string")(F.col(f"`{text}`")))
