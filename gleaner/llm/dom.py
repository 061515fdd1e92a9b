"""A tolerant block tree of a page, its text, and simple tree matching of two such trees.

Reading a page takes time in proportion to its length, whatever it holds: the scanner never looks at a stretch twice, and open
elements are found by name instead of by going through all that are open.
"""

from __future__ import annotations

import heapq
import itertools
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np

# Fixed values of HTML: names of elements by what they mean for blocks of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, or isn't shown, up to their end tag.
RAW = frozenset("script style noscript template iframe textarea title".split())
#: Controls, pictures and players with what they hold; one that is never closed ends with its parent, or where a block begins.
EMBEDDED = frozenset("object canvas svg select button video audio".split())
#: Elements in which "/>" closes, and those in them whose content is ordinary HTML again.
FOREIGN, HTML_IN_FOREIGN = frozenset({"svg", "math"}), frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
REPEATED = frozenset({"p", "li"})
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
GROUPS = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Elements, roles and words in class or id that mark what isn't main text.
ASIDE_TAGS = frozenset("nav aside footer dialog menu head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert"
    " popup modal overlay sidebar sidenav aside widget nav navbar navigation menu breadcrumb breadcrumbs masthead footer comment comments reply replies respond"
    " disqus discussion share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar skip".split()
)
#: Those that say what stands in a node rather than how a page is laid out. There can be more of it than of the main text.
CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion cookie cookies consent gdpr comment comments reply replies respond disqus"
    " discussion".split()
)

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: A tag that ends before the next "<"; what is read is never given back.
_USUAL = re.compile(r"<(/?)([a-zA-Z][^\s/><\"']*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNQUOTED_END = re.compile(r"=\s*[^\s\"'=]+\Z")
_WORD = re.compile(r"[a-zA-Z][a-z0-9]*|[A-Z0-9]+")


NONE, FORM = frozenset(), frozenset({"form"})


class Node:
    """A block element, or an inline one that isn't main text. ``items`` are its texts and nodes in order.

    ``words``: those of its name that mark it as aside, if nothing else does; a form has its own. ``linked``: characters of its
    texts that are within links. ``template``: all of it is the template's; ``fixed``: its own texts are, but not its nodes.
    """

    __slots__ = ("tag", "label", "items", "aside", "inline", "template", "fixed", "words", "linked")

    def __init__(self, tag: str, label: str, aside: bool, inline: bool = False, words: frozenset[str] = frozenset()):
        self.tag, self.label, self.aside, self.inline, self.template = tag, label, aside or bool(words), inline, False
        self.words, self.linked, self.fixed = frozenset() if aside else words, 0, False
        self.items: list = []


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text else {}


def _is_aside(tag: str, attributes: dict[str, str]) -> bool:
    if tag in ASIDE_TAGS or tag in EMBEDDED or "hidden" in attributes or attributes.get("role", "").lower() in ASIDE_ROLES:
        return True
    if attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "").lower()):
        return True
    return False


def _aside_words(tag: str, attributes: dict[str, str]) -> frozenset[str]:
    """What only hints that an element isn't main text: words in class or id, and that it is a form."""
    if tag in ("html", "body", "main", "article"):
        return frozenset()
    words = ASIDE_WORDS.intersection(w.lower() for w in _WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}"))
    return words | {"form"} if tag == "form" else words


class _Open(NamedTuple):
    """An element that is open while a page is read: its name, the node that takes its text, and what holds for what is in it."""

    name: str
    node: Node
    block: bool
    linked: bool = False
    foreign: bool = False
    brief: bool = False  # has no end tag of its own, and so ends where a block begins


class _Tag(NamedTuple):
    """A tag from ``start`` up to ``end``; a comment or declaration has no name."""

    start: int
    end: int
    closing: bool = False
    name: str = ""
    source: str = ""


class _Tags:
    """The tags of a page in order.

    A tag ends at the first ">" outside of quotes; where quotes don't close, at the first of all. Without any, "<" is text.
    """

    def __init__(self, html: str):
        self.html, self.at, self.last = html, 0, html.rfind(">")
        self.stops: list[int] | None = None
        self.ends: dict[int, int] = {}  # of each stop that was reached outside of quotes: where its tag ends, -1 if it doesn't

    def _end(self, at: int) -> int:
        passed = []
        if self.stops is None:
            self.stops = [m.start() for m in _STOP.finditer(self.html)]
        while True:
            i = bisect_left(self.stops, at)
            if i == len(self.stops):
                end = -1
                break
            stop = self.stops[i]
            if stop in self.ends:
                end = self.ends[stop]
                break
            passed.append(stop)
            if self.html[stop] == ">":
                end = stop
                break
            close = self.html.find(self.html[stop], stop + 1)
            if close < 0:
                end = -1
                break
            at = close + 1
        for stop in passed:
            self.ends[stop] = end
        return end

    def _from(self, at: int) -> _Tag | None:
        """The tag at the "<" at ``at``; None if it is none."""
        html = self.html
        if m := _USUAL.match(html, at):
            return _Tag(at, m.end(), bool(m[1]), m[2].lower(), m[3])
        if html.startswith("<!--", at):
            close = html.find("-->", at + 4)
            return _Tag(at, close + 3 if close >= 0 else len(html))
        if html.startswith(("<!", "<?"), at):
            close = html.find(">", at)
            return _Tag(at, close + 1 if close >= 0 else len(html))
        m = _NAME.match(html, at) if at < self.last else None
        if m is None:
            return None
        close = self._end(m.end())
        if close < 0:
            close = html.find(">", m.end())
        return _Tag(at, close + 1, bool(m[1]), m[2].lower(), html[m.end() : close])

    def __iter__(self) -> Iterator[_Tag]:
        while (at := self.html.find("<", self.at)) >= 0:
            tag = self._from(at)
            self.at = at + 1 if tag is None else tag.end
            if tag is not None:
                yield tag


class _Stack:
    """The open elements, with their places by name, those of blocks, and those of brief ones."""

    def __init__(self, root: _Open):
        self.items, self.blocks, self.brief = [root], [0], []
        self.places: dict[str, list[int]] = {}

    def push(self, item: _Open) -> None:
        at = len(self.items)
        self.places.setdefault(item.name, []).append(at)
        if item.block:
            self.blocks.append(at)
        if item.brief:
            self.brief.append(at)
        self.items.append(item)

    def cut(self, at: int) -> None:
        while len(self.items) > at:
            item = self.items.pop()
            self.places[item.name].pop()
            if item.block:
                self.blocks.pop()
            if item.brief:
                self.brief.pop()

    def pop_to(self, names, stop) -> None:
        """Closes the last of ``names`` and what is in it, unless one of ``stop`` was opened after it."""
        at, places = 0, self.places
        for name in names:
            if (p := places.get(name)) and p[-1] > at:
                at = p[-1]
        if at:
            for name in stop:
                if (p := places.get(name)) and p[-1] > at:
                    return
            self.cut(at)

    def end(self, name: str) -> None:
        at = self.places.get(name)
        if at and (name in BLOCKS or self.blocks[-1] < at[-1]):
            self.cut(at[-1])

    def end_brief(self) -> None:
        while self.brief and self.brief[-1] > self.blocks[-1]:
            self.cut(self.brief[-1])


def parse(html: str) -> Node:
    """The tree of a page. Never fails: unclosed elements end with what holds them, end tags without a start are ignored."""
    root = Node("#root", "#root", False)
    stack = _Stack(_Open("#root", root, True))
    at = 0
    without: set[str] = set()  # embedded elements of which no tag follows
    tags = _Tags(html)

    def unclosed(name: str, at: int) -> bool:
        """Whether the element ``name`` that begins before ``at`` has no end tag before the next of its kind begins."""
        if name not in without:
            tag = re.compile(rf"<(/?){name}(?=[\s/>])", re.I).search(html, at)
            if tag is None:
                without.add(name)
            return tag is None or not tag[1]
        return True

    def take(text: str) -> None:
        top = stack.items[-1]
        top.node.items.append(text)
        if top.linked:
            top.node.linked += len(text.strip())

    for tag in tags:
        if tag.start > at:
            take(unescape(html[at : tag.start]))
        at = tag.end
        name, source = tag.name, tag.source
        if not name:
            continue
        if tag.closing:
            stack.end(name)
            continue
        top = stack.items[-1]
        if (top.foreign or name in FOREIGN) and source.endswith("/") and not _UNQUOTED_END.search(source):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            tags.at = at = close.end() if close else len(html)
            continue
        if name in VOID:
            top.node.items.append(" ") if name != "hr" else top.node.items.append(Node("hr", "hr", False))
            continue
        if not source or source.isspace():
            attributes, aside, hints = {}, name in ASIDE_TAGS or name in EMBEDDED, FORM if name == "form" else NONE
        else:
            attributes = _attributes(source)
            aside, hints = _is_aside(name, attributes), _aside_words(name, attributes)
        if name not in BLOCKS:
            node = top.node
            if aside or hints:
                node = Node(name, name, aside, True, hints)
                top.node.items.append(node)
            linked = top.linked or (name == "a" and "href" in attributes)
            foreign = name in FOREIGN or (top.foreign and name not in HTML_IN_FOREIGN)
            stack.push(_Open(name, node, False, linked, foreign, name in EMBEDDED and name != "svg" and unclosed(name, at)))
            continue
        if top.foreign:
            stack.pop_to(FOREIGN, ())
        stack.end_brief()
        if name == "body":
            stack.pop_to(("head",), ())
        stack.pop_to(("p",), ("td", "th", "table", "button", "object"))
        if name in CLOSED_BY_SAME:
            stack.pop_to(GROUPS.get(name, {name}), CLOSED_BY_SAME[name])
        label = f"{name}.{'.'.join(sorted(attributes['class'].split()))}" if attributes.get("class") else name
        node = Node(name, label, aside, words=hints)
        stack.items[-1].node.items.append(node)
        stack.push(_Open(name, node, True, stack.items[-1].linked))
    if at < len(html):
        take(unescape(html[at:]))
    return root


def release_wrappers(root: Node) -> None:
    """Takes back the mark of asides that only words or a form hint at, where they hold what the page is about.

    That is a main element; or, where no main element or article stands outside of asides, an article, unless more prose stands
    outside; or half of the text that isn't in links. Within a main element, then within an article, it is judged anew.
    Comments, adverts and the like can outweigh a text: with a word for them, also a heading of first rank, a single article, or
    that there is no other text is asked for.
    """
    order, parent = [root], {}
    for node in order:
        for n in node.items:
            if isinstance(n, Node) and (n.words or not n.aside):
                parent[n] = node
                order.append(n)
    if not any(n.words for n in order):
        return
    own = {n: max(0, sum(len(s.strip()) for s in n.items if isinstance(s, str)) - n.linked) for n in order}
    text, has = dict(own), {n: Counter({n.tag: 1}) if n.tag in ("main", "article", "h1") else Counter() for n in order}
    for n in reversed(order[1:]):
        text[parent[n]] += text[n]
        if has[n]:
            has[parent[n]] += has[n]
    scopes = [root]
    while scopes:
        scope = scopes.pop()
        inner = {"#root": ("main", "article"), "main": ("article",)}.get(scope.tag, ())
        waiting: list[tuple[bool, int, int, Node]] = []
        found, prose, todo, turn = [], 0, [(scope, False)], itertools.count()
        while todo or waiting:
            if not todo:
                _, _, _, node = heapq.heappop(waiting)
                whole = 2 * text[node] >= text[scope] > 0 and not found
                article = bool(inner and has[node]["article"]) and not found and text[node] >= prose
                if node.words & CONTENT_WORDS and not (has[node]["h1"] or text[node] == text[scope]):
                    whole, article = False, article and has[node]["article"] == 1
                if not ("main" in inner and has[node]["main"] or whole or article):
                    continue
                node.aside, node.words = False, frozenset()
                todo.append((node, False))
            node, within = todo.pop()
            if node is not scope and node.tag in inner:
                found.append(node)
                continue
            within = within or node.tag in PROSE
            prose += own[node] if within else 0
            for n in node.items:
                if n in parent:
                    if n.words:
                        heapq.heappush(waiting, ("main" not in has[n], -text[n], next(turn), n))
                    else:
                        todo.append((n, within))
        scopes += found


def blocks(roots: list[Node], keep, fixed: bool = True) -> list[str]:
    """The blocks of text below ``roots`` in page order, white space as one blank; subtrees that ``keep`` refuses are left out.

    Without ``fixed``, so are the own texts of nodes that are marked so.
    """
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if text and (line := " ".join("".join(text).split())):
            out.append(line)
        text.clear()

    todo: list = [*reversed(roots)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            text.append(item)
        elif keep(item):
            if not item.inline:
                flush()
                todo.append(None)
            left_out = item.fixed and not fixed
            todo.extend(n for n in reversed(item.items) if not (left_out and isinstance(n, str)))
    flush()
    return out


class Part:
    """A node for matching. Neighbouring paragraphs, or list entries, of one label and without children are one part: a slot
    that pages fill with as many as they have. ``count``: the parts it consists of; ``shape``: equal for equal structures."""

    __slots__ = ("label", "text", "children", "nodes", "count", "shape")

    def __init__(self, node: Node):
        self.label, self.text, self.children, self.nodes, self.count, self.shape = node.label, "", [], [node], 1, 0


def parts(root: Node) -> Part:
    """The tree of parts of a page."""
    top = Part(root)
    todo, order = [(root, top)], []
    while todo:
        node, part = todo.pop()
        order.append((node, part))
        for item in node.items:
            if isinstance(item, Node) and not item.inline:
                part.children.append(child := Part(item))
                todo.append((item, child))
    for node, part in reversed(order):
        text = [x for item in node.items for x in ([item] if isinstance(item, str) else blocks([item], lambda n: n.tag not in EMBEDDED) if item.inline else [])]
        part.text = " ".join("".join(text).split())
        merged: list[Part] = []
        for child in part.children:
            last = merged[-1] if merged else None
            if last is not None and child.nodes[0].tag in REPEATED and not child.children and not last.children and last.label == child.label:
                last.nodes += child.nodes
                last.text += "\n" + child.text
            else:
                merged.append(child)
        part.children = merged
        part.count = 1 + sum(c.count for c in merged)
        part.shape = hash((part.label, *(c.shape for c in merged)))
    return top


def preorder(part: Part) -> list[Part]:
    out, todo = [], [part]
    while todo:
        out.append(p := todo.pop())
        todo.extend(reversed(p.children))
    return out


def _like_ends(x: list[Part], y: list[Part]) -> tuple[int, int]:
    """How many parts at the start, and then at the end, have equal structures in both. A best alignment pairs them."""
    n = min(len(x), len(y))
    start = 0
    while start < n and x[start].shape == y[start].shape:
        start += 1
    end = 0
    while end < n - start and x[-1 - end].shape == y[-1 - end].shape:
        end += 1
    return start, end


class _Matching:
    """Sizes of the largest matchings of parts, kept by their structures; pages of one layout have few of them."""

    def __init__(self):
        self.sizes: dict[tuple[int, int], int] = {}
        self.open: set[tuple[int, int]] = set()

    def _known(self, a: Part, b: Part) -> int | None:
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.count
        if not a.children or not b.children:
            return 1
        return self.sizes.get((a.shape, b.shape))

    def size(self, a: Part, b: Part) -> int:
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is not None:
                todo.pop()
                continue
            if (x.shape, y.shape) in self.open:  # the second time, when all pairs of children are known
                start, end = _like_ends(x.children, y.children)
                xs, ys = x.children[start : len(x.children) - end], y.children[start : len(y.children) - end]
                like = sum(c.count for c in x.children[:start]) + sum(c.count for c in x.children[len(x.children) - end :])
                middle = int(self.last_row(*self.weights(xs, ys))[-1]) if xs and ys else 0
                self.sizes[x.shape, y.shape] = 1 + like + middle
                continue
            self.open.add((x.shape, y.shape))
            start, end = _like_ends(x.children, y.children)
            xs, ys = ({c.shape: c for c in p.children[start : len(p.children) - end]}.values() for p in (x, y))
            todo.extend((p, q) for p in xs for q in ys if self._known(p, q) is None)
        return self._known(a, b)

    def weights(self, x: list[Part], y: list[Part]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(weights by kind of x and of y, kind of each x, kind of each y)."""
        kinds_x, kinds_y = {p.shape: p for p in x}, {q.shape: q for q in y}
        table = np.array([[self.size(p, q) for q in kinds_y.values()] for p in kinds_x.values()], np.int64).reshape(len(kinds_x), len(kinds_y))
        number_x, number_y = ({k: i for i, k in enumerate(kinds)} for kinds in (kinds_x, kinds_y))
        return table, np.array([number_x[p.shape] for p in x], np.int64), np.array([number_y[q.shape] for q in y], np.int64)

    @staticmethod
    def last_row(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Size of the best alignment of all of x with the first j of y, for each j; a row of the table at a time."""
        row = np.zeros(len(y) + 1, np.int64)
        for kind in x:
            row[1:] = np.maximum(row[1:], row[:-1] + table[kind][y])
            np.maximum.accumulate(row, out=row)
        return row

    def aligned(self, table: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """The pairs of places of a best alignment. Halves x and finds where y has to be cut, so one row is held at a time."""
        out, todo = [], [(0, len(x), 0, len(y))]
        while todo:
            x0, x1, y0, y1 = todo.pop()
            if x0 >= x1 or y0 >= y1:
                continue
            if x1 - x0 == 1:
                row = table[x[x0]][y[y0:y1]]
                if row.max() > 0:
                    out.append((x0, y0 + int(row.argmax())))
                continue
            middle = (x0 + x1) // 2
            before = self.last_row(table, x[x0:middle], y[y0:y1])
            behind = self.last_row(table, x[middle:x1][::-1], y[y0:y1][::-1])[::-1]
            cut = y0 + int((before + behind).argmax())
            todo += [(middle, x1, cut, y1), (x0, middle, y0, cut)]
        return sorted(out)


def match(a: Part, b: Part) -> tuple[int, list[tuple[Part, Part]]]:
    """Simple tree matching: the size of the largest matching that keeps labels, order and ancestors, and its pairs.

    Children are aligned by dynamic programming over the sizes of their own matchings.
    """
    if a.label != b.label:
        return 0, []
    matching, pairs, todo = _Matching(), [], [(a, b)]
    size = matching.size(a, b)
    while todo:
        p, q = todo.pop()
        pairs.append((p, q))
        if p.shape == q.shape:
            todo.extend(zip(p.children, q.children))
        elif p.children and q.children:
            start, end = _like_ends(p.children, q.children)
            x, y = p.children[start : len(p.children) - end], q.children[start : len(q.children) - end]
            todo.extend(zip(p.children[:start], q.children[:start]))
            todo.extend(zip(p.children[len(p.children) - end :], q.children[len(q.children) - end :]))
            if x and y:
                todo.extend((x[i], y[j]) for i, j in matching.aligned(*matching.weights(x, y)))
    return size, pairs
