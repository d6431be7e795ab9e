"""Text columns: trimming, regular expressions and word tokens."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word patterns.
# WORD_BOUNDARIES follows the Unicode word-boundary rules: letters may be joined by . : · ' ’ when
# letters stand on both sides, digits by . , ; ' ’ when digits do, and letters, digits and _ run
# together.  The quantifiers are possessive, so a long run of junk cannot exhaust the stack.
WORD_BOUNDARIES = r"(?:\pL[\pL\pM]*+(?:[.:·'’]\pL[\pL\pM]*+)*+|\pN++(?:[.,;'’]\pN++)*+|_)++"
WORD_RUNS = r"[\pL\pN]+"

# Word borders in patterns, which take no letter of a term away.
BORDERS = (r"(^|[^\pL\pN_])", r"($|[^\pL\pN_])", r"\b")

# Whitespace as Python's str.strip sees it.
_LEADING = r"(?U)^[\s\x1c-\x1f]+"
_TRAILING = r"(?U)[\s\x1c-\x1f]+\z"


def trim_left(text: Column) -> Column:
    """Drop leading whitespace of any kind, newlines included."""
    return F.regexp_replace(text, _LEADING, "")


def trim_both(text: Column) -> Column:
    return F.regexp_replace(trim_left(text), _TRAILING, "")


def needles_of(pattern: str) -> list[str]:
    """Plain strings of which every match contains one, if the pattern is an alternation of plain strings
    with or without word borders; else none."""
    for border in BORDERS:
        pattern = pattern.replace(border, "")
    return plain_terms(pattern.split("|"))


def matches(text: Column, pattern: str) -> Column:
    """Regex search with Unicode word rules; null text does not match.

    Plain strings of which every match contains one are looked up first, on the stored bytes, so most
    texts never reach the regex.
    """
    found = text.rlike("(?U)" + pattern)
    hints = [text.contains(needle) for needle in needles_of(pattern)]
    if hints:
        possible = hints[0]
        for hint in hints[1:]:
            possible = possible | hint
        found = possible & found
    return F.coalesce(found, F.lit(False))


def matches_any(columns: Iterable[str], pattern: str) -> Column:
    """True if any of the columns matches."""
    found = F.lit(False)
    for name in columns:
        found = found | matches(F.col(name), pattern)
    return found


def any_of(terms: Iterable[str]) -> str:
    """One alternation from a list of terms."""
    return "|".join(terms)


def plain_terms(terms: Iterable[str]) -> list[str]:
    """The terms if all are plain and none is empty, else nothing."""
    terms = list(terms)
    return [] if any(not term or set(term) & set(r".^$*+?{}[]\|()") for term in terms) else terms


def word_tokens(text: Column, pattern: str = WORD_BOUNDARIES) -> Column:
    """Lower-case words of a whole text, punctuation removed."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def model_input(tokens: Column, limit: int = 128) -> Column:
    """The tokens a model with an input limit sees; only scorers with such a limit use this."""
    return F.slice(tokens, 1, limit)


def absolute_url(base: str, path: Column) -> Column:
    return F.concat(F.lit(base), path)
