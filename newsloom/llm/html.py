"""Main text of pages by template deduction from equivalence classes.

Tokens of a page are its containers (path of tags with class and id) and its text blocks (path and text).
Over all pages of a host each token has an occurrence vector, its count on every page.  Tokens
that share a vector form an equivalence class; classes of tokens found on at least half of the host's
different pages make up the template, nested by their paths.  What the template leaves open are slots.  The main
slot is the innermost template container that holds most of the text that is not template text; where it lies
inside an ``article`` or ``main``, all slots of that element belong to it.

Vectors are never gathered: a vector is represented by the exclusive or of the hashes of its (page, count) pairs, which
combines before and after the shuffle, so a host with a third of all pages costs a few rows a task.  Equal pages of a
host count once.

Where the host has a template, a page's region is the main slot, and text blocks of the template are left out everywhere,
inside articles too; only an ``article`` or ``main`` that the template does not know (say, with an id of its
own on every page) goes before a slot outside it.  A page without the slot, and pages of hosts with fewer than LEAST_PAGES different pages, have as region their
``article`` elements, else ``main``, else all.  A page that consists of template text alone keeps it.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments by readers are left out
by element, role and class.  A class or id that only has such a word as a part (``share-price``) says so
only if its container belongs to the host's template, or the host has none.  Nothing else is left out.

A null or empty page has the text "".  A null address counts as a host of its own.  Broken markup (missing
ends, stray quotes, unclosed tags and comments) is read as browsers do, roughly; reading takes linear time.
Repeated rows are extracted singly; other columns pass through.  An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import ready_for_python
from newsloom.operators.joins import join_checked
from newsloom.session import written_table

LEAST_PAGES = 3  # different pages of a host from which on a template is deduced
MAIN_SHARE = 0.7  # of the open text that the main slot holds

DEEPEST = 64  # containers around a container from which on it is no slot of its own

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article aside body details dialog div footer form header main menu nav ol section table td ul".split())
LEFT_OUT = frozenset(
    "aside button canvas datalist dialog footer form head iframe menu nav noscript object script select search style svg template "
    "textarea title video audio".split()
)
CLASSES_LEFT_OUT = frozenset(
    "ad ads adbox adsbygoogle advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination paywall popup promo promotion recommended related respond replies share sharing sidebar signup skip social "
    "sponsor sponsored sponsorship subscribe subscription toolbar widget widgets".split()
)
ROLES_LEFT_OUT = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
WHOLE_PAGE = frozenset("html body article main".split())  # their classes describe the page, not a part of it
# a quote opens a value only after "="; elsewhere it belongs to a name or an unquoted value
_SPACE = r"\t\n\f\r\x20"
_NAME = rf"(?:=[^{_SPACE}/>=]*+|[^{_SPACE}/>=]++)"
_VALUE = rf"[{_SPACE}]*+=[{_SPACE}]*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^{_SPACE}>]++|(?=>))"
_TAG = re.compile(rf"</?([a-zA-Z][^{_SPACE}/>]*+)((?:[{_SPACE}/]++|{_NAME}(?:{_VALUE}|(?![{_SPACE}]*+=)))*+)>")
_ATTRIBUTE = re.compile(rf"({_NAME})(?:[{_SPACE}]*+=[{_SPACE}]*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^{_SPACE}>]++))?+)?+")
_LETTER = re.compile("[a-zA-Z]")
_PARTS = re.compile(r"[a-z]+")
_TELLS_OF_OTHERS = ("has-", "no-", "with-", "without-")  # names that say what else the page has
_HIDDEN = re.compile(r"display\s*:\s*none", re.IGNORECASE)


@dataclass
class Block:
    path: int  # hash of the container path
    text: str
    out: bool  # within something left out
    article: int | None  # path of the outermost open article
    main: int | None
    containers: tuple[int, ...]
    linked: int  # characters inside links


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)} if source.strip() else {}


def left_out(name: str, attrs: dict[str, str], in_article: bool, known: bool = True) -> bool:
    """known: whether the part is on most pages of its host, so that a part of its class or id is enough."""
    if name in LEFT_OUT or name == "header" and not in_article:
        return True
    if attrs.get("role", "").lower() in ROLES_LEFT_OUT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        return name not in WHOLE_PAGE
    if name in WHOLE_PAGE:
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    names = [n for n in names if not n.startswith(_TELLS_OF_OTHERS)]
    parts = {p for n in names for p in _PARTS.findall(n)} if known else set(names)
    return bool(parts & CLASSES_LEFT_OUT) or "header" in parts and not in_article


def token(*parts) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def blocks(page: str | None, frame: frozenset[int] | None = None) -> Iterator[Block]:
    """frame: the containers of the host's template, if it has one.

    Text blocks in page order.  An end tag without open element is skipped; an element is closed by the end of one around it."""
    page = page or ""
    stack: list[tuple] = []  # name, whether it is left out, previous path and containers
    open_names: dict[str, int] = {}
    outermost: dict[str, int] = {}  # paths of articles and mains
    depth_out = depth_link = 0
    path, containers = token(""), ()
    parts: list[str] = []
    linked = at = 0

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        article, main = (outermost[n] if open_names.get(n) else None for n in ("article", "main"))
        block = Block(path, text, depth_out > 0, article, main, containers, linked) if text else None
        parts, linked = [], 0
        return block

    while at < len(page):
        start = page.find("<", at)
        start = len(page) if start < 0 else start
        if start > at:
            plain = entities.unescape(page[at:start])
            parts.append(plain)
            linked += len(plain) if depth_link else 0
        if start == len(page):
            break
        following = page[start + 1 : start + 2]
        if following in ("!", "?") or following == "/" and not _LETTER.match(page, start + 2):
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + (2 if comment and page.startswith("<!-->", start) else 4 if comment else 1))
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        if not _LETTER.match(following) and following != "/":
            parts.append("<")
            at = start + 1
            continue
        found = _TAG.match(page, start)
        if found is None:  # a tag that never ends takes the rest of the page with it
            break
        at, name, closing = found.end(), found[1].lower(), following == "/"
        if name in BLOCK and (block := flush()):
            yield block
        if name == "br":
            parts.append(" ")
        if closing:
            if open_names.get(name):
                while True:
                    closed, out, path, containers = stack.pop()
                    open_names[closed] -= 1
                    depth_out -= out
                    depth_link -= closed == "a"
                    if closed == name:
                        break
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            at = len(page) if end is None else end.start()
            close = page.find(">", at)
            at = len(page) if close < 0 else close + 1
            continue
        if found[2].rstrip().endswith("/") and name not in BLOCK and name != "a":
            continue
        attrs = attributes(found[2])
        before, around = path, containers
        if name in CONTAINERS and len(containers) < DEEPEST:
            path = token(path, name, attrs.get("class", ""), attrs.get("id", ""))
            containers = (*containers, path)
        out = left_out(name, attrs, bool(open_names.get("article")), frame is None or path in frame)
        stack.append((name, out, before, around))
        if name in ("article", "main") and not open_names.get(name):
            outermost[name] = path
        open_names[name] = open_names.get(name, 0) + 1
        depth_out += out
        depth_link += name == "a"
    if block := flush():
        yield block


def page_tokens(page: str | None) -> list[tuple]:
    """(token, kind, count, depth, open characters, container around it): kind 0 containers with the text below them, 1 text blocks."""
    rows: dict[tuple[int, int], list[int]] = {}
    for b in blocks(page):
        free = 0 if b.out else max(0, len(b.text) - b.linked)
        for depth, c in enumerate(b.containers):
            row = rows.setdefault((c, 0), [1, depth, 0, b.containers[depth - 1] if depth else 0])
            row[2] += free
        row = rows.setdefault((token(b.path, b.text), 1), [0, len(b.containers), 0, b.path])
        row[0] += 1
        row[2] += free
    return [(t, kind, *row) for (t, kind), row in rows.items()]


def main_slot(nest: list[tuple[int, int, int, int]], texts: list[tuple[int, int]]) -> int | None:
    """The innermost container that holds most of what is open without template texts.  nest: (depth, token, open, container
    around it); texts: (open, container)."""
    left = {t: n for _, t, n, _ in nest}
    around = {t: c for _, t, _, c in nest}
    for n, c in texts:
        while c in left:
            left[c] -= n
            c = around[c]
    most = max(left.values(), default=0)
    return max(((depth, t) for depth, t, _, _ in nest if left[t] >= MAIN_SHARE * most), default=(0, None))[1]


def by_names(found: list[Block]) -> list[Block]:
    """The blocks in articles, else in main, else all."""
    return [b for b in found if b.article is not None] or [b for b in found if b.main is not None] or found


def region(found: list[Block], slot: int | None, frame: frozenset[int]) -> list[Block]:
    inside = [b for b in found if slot in b.containers]
    if not inside:
        return by_names(found)
    for kind in ("article", "main"):
        path_of = [(b, getattr(b, kind)) for b in found]
        wider = {p for b, p in path_of if p in b.containers and slot in b.containers[b.containers.index(p) :]}
        if wider:
            return [b for b, p in path_of if p in wider]
        unknown = [b for b, p in path_of if p is not None and p not in frame]
        if unknown:
            return unknown
        if any(p is not None for _, p in path_of):
            break
    return inside


def main_text(page: str | None, template: set[int], slot: int | None, frame: frozenset[int] | None = None) -> str:
    """The blocks of the page's region, joined by empty lines.  template: its text blocks; frame: its containers, none if the
    host has no template."""
    found = [b for b in blocks(page, frame) if not b.out]
    if frame is None:
        chosen = by_names(found)
    else:
        left = [b for b in found if token(b.path, b.text) not in template]
        chosen = region(left or found, slot, frame)
    return "\n\n".join(b.text for b in chosen)


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url}`").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(_host, texts, frame, slot): the text blocks and containers of the host's template and the container of its main slot."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([page_tokens(p) for p in rows], dtype=object)

    def slots(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for nests, texts in batches:
            yield pd.Series(
                [
                    main_slot([(x["depth"], x["token"], x["open"], x["around"]) for x in n], [(x["open"], x["around"]) for x in t])
                    for n, t in zip(nests, texts, strict=True)
                ],
                dtype="Int64",
            )

    kind = "array<struct<token: long, kind: int, n: int, depth: int, open: long, around: long>>"
    each = ready_for_python(pages).select(
        host_of(url).alias("_host"), F.xxhash64(f"`{page}`").alias("_page"), F.pandas_udf(run, kind)(F.col(f"`{page}`")).alias("_tokens")
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("token"), F.lit(2).alias("kind"), F.lit(1).alias("n"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("around")))
    rows = each.select("_host", "_page", F.explode(F.concat("_tokens", whole)).alias("t")).select("_host", "_page", "t.*")
    once = rows.groupBy("_host", "_page", "token", "kind").agg(F.max("n").alias("n"), F.max("depth").alias("depth"), F.max("open").alias("open"), F.max("around").alias("around"))
    stats = once.groupBy("_host", "token", "kind").agg(
        F.count(F.lit(1)).alias("support"), F.bit_xor(F.xxhash64("_page", "n")).alias("vector"), F.max("depth").alias("depth"), F.sum("open").alias("open"),
        F.max("around").alias("around"),
    )
    stats = written_table(stats.filter(F.col("support") >= LEAST_PAGES), "occurrences")
    totals = stats.filter(F.col("kind") == 2).select("_host", F.col("support").alias("pages"))
    frequent = stats.filter(F.col("kind") < 2).join(totals, "_host").filter(F.col("support") * 2 >= F.col("pages"))
    # a class is a vector; text alone that shares its vector with no container is chance
    classes = frequent.groupBy("_host", "vector").agg(
        F.max(F.when(F.col("kind") == 0, 1).otherwise(0)).alias("framed"),
        F.collect_list(F.when(F.col("kind") == 1, F.struct("token", "open", "around"))).alias("texts"),
        F.collect_list(F.when(F.col("kind") == 0, F.struct("depth", "token", "open", "around"))).alias("nest"),
    )
    nested = classes.groupBy("_host").agg(
        F.flatten(F.collect_list(F.when(F.col("framed") == 1, F.col("texts")))).alias("texts"), F.flatten(F.collect_list("nest")).alias("nest")
    )
    slot = F.pandas_udf(slots, "long")("nest", "texts")
    return written_table(nested.select("_host", F.col("texts.token").alias("texts"), F.col("nest.token").alias("frame"), slot.alias("slot")), "templates")


def extract(pages: DataFrame, url: str = "url", page: str = "html", out: str = "text") -> DataFrame:
    """Add the main text of each page."""
    found = templates(pages, url, page)
    sides = found.select("_host", F.col("texts").alias("_texts"), F.col("frame").alias("_frame"), F.col("slot").cast("string").alias("_slot"))
    whole = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    aside = pages.select(host_of(url).alias("_host"), F.col(f"`{page}`").alias("_page"), whole.alias("_row"))
    joined = join_checked(aside, sides, "_host", "left", bound=measured(found))

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def held(tokens) -> frozenset[int] | None:
            return None if tokens is None else frozenset(np.asarray(tokens).tolist())

        for rows, texts, frames, slots in batches:
            yield pd.Series(
                [
                    main_text(p, held(t) or set(), None if s is None else int(s), held(f))
                    for p, t, f, s in zip(rows, texts, frames, slots, strict=True)
                ],
                dtype=object,
            )

    made = joined.select("_row", F.pandas_udf(run, "string")("_page", "_texts", "_frame", "_slot").alias("_main"))
    return made.select(*[F.col("_row")[c].alias(c) for c in pages.columns if c != out], F.col("_main").alias(out))


def measured(found: DataFrame) -> DataFrame:
    """The templates with their lists spread out, so that measuring counts their bytes."""
    return found.select("_host", F.explode_outer(F.concat("texts", "frame")).alias("t"))
