"""Quality rules: counts of words, symbols and repeats, and compression bands.

A text that zstandard shrinks far more than prose repeats itself; one that it hardly shrinks is noise.
How far prose shrinks depends on its length, so each length has its own band, for the whole text and for
fixed chunks of it (a repetitive stretch in a long text hardly moves the ratio of the whole).

A null or empty text has no words and fails the base rule.  Texts are read whole.  Repeated rows are
judged singly; other columns are not looked at, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import ready_for_python, unpacked, words

_SYMBOLS = re.compile(r"[#*$%&|<>]+")
_SPACES = " \t\n\v\f\r"
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, bad_chunk_share double, kept boolean"
)


@dataclass(frozen=True)
class Bands:
    """Ratios (bytes to compressed bytes) that prose stays within, by length in bytes.

    ``whole``: rows (length below which the row holds, lowest, highest ratio).  ``chunk_band`` holds for
    chunks of ``chunk_bytes``; a last piece of less than half a chunk goes with the one before it.
    """

    whole: tuple[tuple[float, float, float], ...] = (
        (512, 1.10, 2.2),
        (1024, 1.20, 2.3),
        (4096, 1.30, 2.6),
        (16384, 1.40, 2.9),
        (65536, 1.45, 3.3),
        (float("inf"), 1.45, 4.0),
    )
    chunk_bytes: int = 2048
    chunk_band: tuple[float, float] = (1.25, 2.6)
    bad_chunk_share: float = 0.2
    level: int = 3


def repeated_words(found: list[bytes]) -> int:
    """Words that stand in a 3-word window found at least twice in the text."""
    if len(found) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in found], np.int64)
    n = len(known)
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    filled = [line for line in text.split("\n") if line.strip(_SPACES)]
    return len(filled) - len(set(filled))


def judge(text: str | None, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode()
    found = words(text)
    n = len(found)
    chars = len(text) - sum(map(text.count, _SPACES))
    repeats = repeated_words(found)
    failed = n < 50 or 100 * repeats > 50 * n
    ratio = len(data) / len(packer.compress(data)) if data else 0.0
    low, high = next((a, b) for below, a, b in bands.whole if len(data) < below)
    edges = list(range(0, max(1, len(data) - bands.chunk_bytes // 2), bands.chunk_bytes)) + [len(data)]
    bad = 0
    if len(edges) > 2:
        for a, b in zip(edges, edges[1:], strict=False):
            r = (b - a) / len(packer.compress(data[a:b]))
            bad += (b - a) * (not bands.chunk_band[0] <= r <= bands.chunk_band[1])
    share = bad / len(data) if data else 0.0
    kept = not failed and low <= ratio <= high and share <= bands.bad_chunk_share
    return n, chars, sum(map(len, _SYMBOLS.findall(text))), repeated_lines(text), repeats, failed, ratio, share, kept


def quality(df: DataFrame, id_col: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:  # noqa: B008
    """Per row the id and the columns of ``SCHEMA``."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=bands.level, write_checksum=False)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for texts in batches:
            yield pd.DataFrame([judge(t, bands, packer) for t in texts], columns=names)

    judged = ready_for_python(df).select(F.col(f"`{id_col}`"), F.pandas_udf(run, SCHEMA)(F.col(f"`{text}`")).alias("_judged"))
    return unpacked(judged, "_judged", *[c.split()[0] for c in SCHEMA.split(", ")])
