"""A small reading of one page, run inside Python workers on Arrow batches: tags, then a tree repaired as browsers do it.

An element is described by a tag name, a class, or both: ``h1``, ``.article-title``, ``p.lead``.  Reading takes time in proportion
to the page, whatever is in it, and gives up on none.
"""

from __future__ import annotations

import re
from bisect import bisect, insort
from collections.abc import Iterator
from html import unescape
from html.entities import html5

# Fixed values, as HTML defines them.  Elements without content; with text only (of the last two it has character references); those that
# bound what an end tag or an open paragraph can reach; those whose start ends an open paragraph; those reopened in the next block if that
# block ends before them; parts of tables that hold no text; elements of the head.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
TEXT_ONLY = frozenset("script style xmp iframe noembed noframes textarea title".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dialog dir div dl dt "
    "embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing "
    "main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary "
    "table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
END_PARAGRAPH = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
IN_LINE = frozenset("area br button embed img input keygen select wbr xmp".split())  # special, but part of a line
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
SECTIONS = ("tbody", "tfoot", "thead")
CELLS = ("td", "th", "caption")
IN_TABLE = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
MARKED = frozenset("applet caption marquee object td template th".split())  # formatting does not reach into these
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SCOPE = ("applet", "caption", "table", "td", "th", "marquee", "object", "template")
BUTTON_SCOPE = (*SCOPE, "button")
THROUGH = frozenset("address div p".split())  # an item of a list ends the one before through these

GONE = "!"  # stands in the place of an element that ended before those within it

REOPENED = 100  # open formatting elements that go on in the next block; without a bound a page could unfold to its square

_SPACE = r"\t\n\f\r\x20"
_NAME = rf"(?:=[^{_SPACE}/>=]*+|[^{_SPACE}/>=]++)"
_TAG = re.compile(rf"</?+([a-zA-Z][^{_SPACE}/>]*+)((?:[{_SPACE}/]++|{_NAME}(?:[{_SPACE}]*+=[{_SPACE}]*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^{_SPACE}>]++|(?=>))|(?![{_SPACE}]*+=)))*+)>")
_ATTRIBUTE = re.compile(rf"({_NAME})(?:[{_SPACE}]*+=[{_SPACE}]*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^{_SPACE}>]++))?+)?+")
_OPENS = re.compile(r"/?[a-zA-Z]|[!?/]")
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(#?[a-zA-Z0-9]++)(;?)(=?)")
_BLANK = re.compile(rf"[{_SPACE}]*+\Z")


def parse_selector(selector: str) -> tuple[str | None, str | None]:
    tag, _, css = selector.partition(".")
    return (tag or None, css or None)


def _attribute_value(value: str) -> str:
    """References decoded; a name without semicolon only if nothing follows that could belong to an address."""

    def one(m: re.Match) -> str:
        name, ended, equals = m.groups()
        known = ended or name.startswith("#") or not equals and name in html5
        return unescape(f"&{name}{ended}") + equals if known else m[0]

    return _REFERENCE.sub(one, value) if "&" in value else value


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), _attribute_value(double or single or bare))  # of equal names the first counts
    return found


class Node:
    """An element: its content in order, the list it stands in, what was moved in front of it, and its place among the open ones."""

    __slots__ = ("at", "attrs", "before", "content", "home", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs = name, attrs
        self.content: list[Node | str] = []
        self.home: list | None = None
        self.before: list[Node | str] = []
        self.at = -1


class Tree:
    """Open elements and open formatting; the places of open elements are kept by name, so no tag makes the walk search them."""

    def __init__(self, page: str):
        self.root = Node("", {})
        self.open: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.special: list[int] = []
        self.walls: list[int] = []
        self.formatting: list[Node | None] = []  # None where an element of MARKED began
        self.seen: set[str] = set()
        self._push(self.root)
        self._read(page.replace("\r\n", "\n").replace("\r", "\n"))

    # tags and text

    def _read(self, page: str) -> None:
        at, text, after_pre = 0, [], False

        def flush():
            nonlocal after_pre
            if text:
                whole = "".join(text)
                self._text(whole[1:] if after_pre and whole.startswith("\n") else whole)
                text.clear()
            after_pre = False

        while at < len(page):
            start = page.find("<", at)
            start = len(page) if start < 0 else start
            if start > at:
                text.append(unescape(page[at:start]))
            at = start
            if start == len(page):
                break
            begun = _OPENS.match(page, start + 1)
            if begun is None:
                text.append("<")
                at += 1
                continue
            flush()
            if not begun[0][-1].isalpha():  # comments, declarations, "</" before anything but a letter
                if page.startswith("<!--", start):
                    end = _COMMENT_END.search(page, start + (2 if page.startswith(("<!-->", "<!--->"), start) else 4))
                    at = len(page) if end is None else end.end()
                else:
                    end = page.find(">", start)
                    at = len(page) if end < 0 else end + 1
                continue
            tag = _TAG.match(page, start)
            if tag is None:  # a tag that never ends takes the rest of the page with it
                return
            at, name = tag.end(), tag[1].lower()
            if begun[0][0] == "/":
                self._end(name)
            elif (node := self._start(name, _attributes(tag[2]))) is not None and name in TEXT_ONLY:
                end = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(page, at)
                raw = page[at : len(page) if end is None else end.start()]
                node.content.append(unescape(raw.removeprefix("\n") if name == "textarea" else raw) if name in ("textarea", "title") else raw)
                self._pop()
                close = -1 if end is None else page.find(">", end.start())
                at = len(page) if close < 0 else close + 1
            elif node is not None and name == "plaintext":
                node.content.append(page[at:])
                return
            else:
                after_pre = name in ("pre", "listing")
        flush()

    # open elements

    def _last(self, names) -> int:
        place = -1
        for name in names:
            if (places := self.places.get(name)) and places[-1] > place:
                place = places[-1]
        return place

    def _in_scope(self, names, bounds=SCOPE) -> bool:
        place = self._last(names)
        return place >= 0 and self._last(bounds) <= place  # a bound may be one of the names

    def _lists(self, name: str) -> Iterator[list[int]]:
        yield self.places.setdefault(name, [])
        if name in SPECIAL:
            yield self.special
            if name not in THROUGH:
                yield self.walls

    def _push(self, node: Node) -> None:
        node.at = len(self.open)
        self.open.append(node)
        self.places.setdefault(node.name, []).append(node.at)
        if node.name in SPECIAL:
            self.special.append(node.at)
            if node.name not in THROUGH:
                self.walls.append(node.at)

    def _pop(self) -> None:
        node = self.open.pop()
        self.places[node.name].pop()
        if node.name in SPECIAL:
            self.special.pop()
            if node.name not in THROUGH:
                self.walls.pop()
        node.at = -1
        if node.name in MARKED:
            while self.formatting and self.formatting.pop() is not None:
                pass
        if self.open[-1].name == GONE:
            self._pop()

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            self._pop()

    def _replace(self, first: int, nodes: list[Node]) -> None:
        """Put as many other nodes in place of the open ones from ``first`` on; those further in keep their places."""
        for node in self.open[first : first + len(nodes)]:
            for places in self._lists(node.name):
                del places[bisect(places, node.at) - 1]
            node.at = -1
        for at, node in enumerate(nodes, first):
            self.open[at], node.at = node, at
            for places in self._lists(node.name):
                insort(places, at)

    def _place(self, item: Node | str, target: Node | None = None, inside: bool = False) -> None:
        """Into the innermost open element, but in front of the table if that is a part of one."""
        target = target or self.open[-1]
        home = target.content
        if target.name in TABLE_PARTS and not inside:
            home = self.open[self._last(("table",))].before
        home.append(item)
        if isinstance(item, Node):
            item.home = home

    def _insert(self, name: str, attrs: dict[str, str], inside: bool = False) -> Node:
        node = Node(name, attrs)
        self._place(node, inside=inside)
        if name not in VOID:
            self._push(node)
        return node

    def _reopen(self) -> None:
        """Formatting that was open when its block ended goes on here."""
        active = self.formatting
        if not active or active[-1] is None or active[-1].at >= 0:
            return
        first = len(active) - 1
        while first > 0 and active[first - 1] is not None and active[first - 1].at < 0:
            first -= 1
        for k in range(first, len(active)):
            active[k] = self._insert(active[k].name, active[k].attrs)

    def _since_mark(self) -> int:
        first = len(self.formatting)
        while first > 0 and self.formatting[first - 1] is not None:
            first -= 1
        return first

    def _format(self, node: Node) -> None:
        first = self._since_mark()
        alike = [k for k in range(first, len(self.formatting)) if (self.formatting[k].name, self.formatting[k].attrs) == (node.name, node.attrs)]
        if len(alike) >= 3:
            del self.formatting[alike[0]]
        elif len(self.formatting) - first >= REOPENED:
            del self.formatting[first]
        self.formatting.append(node)

    # what tags and text do

    def _text(self, text: str) -> None:
        top = self.open[-1].name
        if (top == "head" or top in TABLE_PARTS) and _BLANK.match(text):
            self._place(text, inside=True)
            return
        if top == "head":
            self._pop()
        self._reopen()
        self._place(text)

    def _start(self, name: str, attrs: dict[str, str]) -> Node | None:
        if name in ("html", "head", "body"):
            if name in self.seen or name == "head" and "body" in self.seen:
                return None
            self.seen.add(name)
        if self.open[-1].name == "head" and name not in HEAD:
            self._pop()
        if name in IN_TABLE:
            return self._table_part(name, attrs)
        if name in END_PARAGRAPH and self._in_scope(("p",), BUTTON_SCOPE):
            self._pop_to(self._last(("p",)))
        top = self.open[-1].name
        if name == "table" and top in TABLE_PARTS:
            self._pop_to(self._last(("table",)))
        elif name in HEADINGS and top in HEADINGS or name in ("option", "optgroup") and top == "option":
            self._pop()
        elif name in ("li", "dd", "dt"):
            wall = self.open[self.walls[-1]].name if self.walls else ""
            if wall == name == "li" or {wall, name} <= {"dd", "dt"}:
                self._pop_to(self.walls[-1])
                if self._in_scope(("p",), BUTTON_SCOPE):
                    self._pop_to(self._last(("p",)))
        elif name in ("button", "nobr") and self._in_scope((name,)):
            self._end(name)
        elif name == "a":
            for old in self.formatting[self._since_mark() :]:
                if old.name == "a":
                    self._end("a")
                    if old in self.formatting:
                        self.formatting.remove(old)
                    if old.at >= 0:
                        self._replace(old.at, [Node(GONE, {})])
                    break
        if name not in SPECIAL or name in IN_LINE:
            self._reopen()
        node = self._insert("img" if name == "image" else name, attrs, inside=name in ("script", "style", "template"))
        if name in FORMATTING:
            self._format(node)
        elif name in MARKED:
            self.formatting.append(None)
        return node

    def _table_part(self, name: str, attrs: dict[str, str]) -> Node | None:
        if not self._in_scope(("table",), ("template",)):
            return None
        table = self._last(("table",))
        around = ("tr",) if name in ("td", "th") else SECTIONS if name == "tr" else ("colgroup",) if name == "col" else ()
        self._pop_to(max(table, self._last(around)) + 1)
        for missing, has in (("colgroup", name == "col"), ("tbody", name in ("td", "th", "tr")), ("tr", name in ("td", "th"))):
            if has and (self.open[-1].name == "table" or missing == "tr" and self.open[-1].name in SECTIONS):
                self._insert(missing, {}, inside=True)
        node = self._insert(name, attrs, inside=True)
        if name in CELLS:
            self.formatting.append(None)
        return node

    def _end(self, name: str) -> None:
        if name in ("html", "body"):  # what follows still belongs to the body
            return
        if name == "br":
            self._start("br", {})
        elif name == "p":
            if not self._in_scope(("p",), BUTTON_SCOPE):
                self._insert("p", {})
            self._pop_to(self._last(("p",)))
        elif name in HEADINGS:
            if self._in_scope(HEADINGS):
                self._pop_to(self._last(HEADINGS))
        elif name in FORMATTING:
            self._end_formatting(name)
        elif name in SPECIAL:
            bounds = ("table", "template") if name in IN_TABLE or name == "table" else (*SCOPE, "ol", "ul") if name == "li" else SCOPE
            if self._in_scope((name,), bounds):
                self._pop_to(self._last((name,)))
        else:
            self._end_other(name)

    def _end_other(self, name: str) -> None:
        place = self._last((name,))
        if place > (self.special[-1] if self.special else -1):
            self._pop_to(place)

    def _end_formatting(self, name: str) -> None:
        """The end of a formatting element inside blocks that it holds: the blocks leave it, and their content keeps the format."""
        active = self.formatting
        if self.open[-1].name == name and self.open[-1] not in active:
            self._pop()
            return
        for _ in range(8):  # as many times as HTML says
            found = next((k for k in range(len(active) - 1, self._since_mark() - 1, -1) if active[k].name == name), None)
            if found is None:
                return self._end_other(name)
            format_ = active[found]
            if format_.at < 0:
                del active[found]
                return
            if format_.at < self._last(SCOPE):
                return
            inner = bisect(self.special, format_.at)
            if inner == len(self.special):
                self._pop_to(format_.at)
                del active[found]
                return
            block = self.open[self.special[inner]]
            first, last, mark, kept, count = format_.at, block, found, [], 0
            for node in reversed(self.open[first + 1 : block.at]):
                count += node.name != GONE
                if count > 3 and node in active:
                    mark -= active.index(node) < mark
                    active.remove(node)
                if node not in active:
                    continue
                clone = Node(node.name, node.attrs)
                active[active.index(node)] = clone
                mark = active.index(clone) + 1 if last is block else mark
                self._move(last, clone.content)
                kept.append(clone)
                last = clone
            around = first - 1
            while self.open[around].name == GONE:
                around -= 1
            self._detach(last)
            self._place(last, self.open[around])
            clone = Node(name, format_.attrs)
            clone.content, block.content = block.content, []
            self._move(clone, block.content)
            mark -= active.index(format_) < mark
            active.remove(format_)
            active.insert(mark, clone)
            gone = [Node(GONE, {}) for _ in range(block.at - first - 1 - len(kept))]
            self._replace(first, [*gone, *reversed(kept), block, clone])

    def _detach(self, node: Node) -> None:
        if node.home is not None:
            for k in range(len(node.home) - 1, -1, -1):
                if node.home[k] is node:
                    del node.home[k]
                    break

    def _move(self, node: Node, home: list) -> None:
        self._detach(node)
        home.append(node)
        node.home = home

    def events(self) -> Iterator[tuple[int, Node | str]]:
        """In page order: (1, element that begins), (0, text), (-1, element that ends)."""
        todo: list = list(reversed(self.root.content))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                yield 0, item
                continue
            if isinstance(item, Node):
                if item.before:
                    todo.append((1, item))
                    todo.extend(reversed(item.before))
                    continue
                item = (1, item)
            yield item
            if item[0] == 1:
                todo.append((-1, item[1]))
                todo.extend(reversed(item[1].content))


def first_elements(html: str | None, fields: list[tuple[str, str | None]]) -> list[str | None]:
    """Text, or one attribute, of the first element per selector; all null for a page that is null."""
    values: list[str | None] = [None] * len(fields)
    wanted = [(i, *parse_selector(selector), attr) for i, (selector, attr) in enumerate(fields)]
    collecting: dict[int, list[str]] = {}
    started: dict[int, list[int]] = {}  # by element
    for kind, item in Tree(html).events() if html is not None else ():
        if kind == 0:
            for parts in collecting.values():
                parts.append(item)
        elif kind < 0:
            for i in started.pop(id(item), ()):
                values[i] = "".join(collecting.pop(i))
        elif wanted:
            classes = item.attrs.get("class", "").split()
            found = [w for w in wanted if (w[1] is None or w[1] == item.name) and (w[2] is None or w[2] in classes)]
            for i, _, _, attr in found:
                if attr:
                    values[i] = item.attrs.get(attr)
                else:
                    collecting[i] = []
                    started.setdefault(id(item), []).append(i)
            wanted = [w for w in wanted if w not in found] if found else wanted
    return values


def first_links(html: str | None, container: str) -> list[str | None]:
    """``href`` of the first link inside every container that holds one, in page order; none for a page that is null."""
    links: list[list] = []  # [found, href]
    waiting: dict[int, int] = {}  # by element
    for kind, item in Tree(html).events() if html is not None else ():
        if kind == 1:
            if item.name == "a":
                for i in waiting.values():
                    links[i] = [True, item.attrs.get("href")]
                waiting = {}
            if item.name == container:
                waiting[id(item)] = len(links)
                links.append([False, None])
        elif kind == -1:
            waiting.pop(id(item), None)
    return [href for found, href in links if found]
