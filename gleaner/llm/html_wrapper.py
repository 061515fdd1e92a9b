"""Main text of pages by wrapper induction.

Every host has reference pages, one for each of its most frequent layouts. A page is aligned with the reference of its own
layout, or else with the one that it shares most nodes with, by simple tree matching. For each node of a reference the pages
that have it, and those that have it with the same text, are counted. A text that nearly all pages hold unchanged is template,
be it a node's whole text or what stands between a node's children; the others are slots, whose content varies. A page's main text
is what its slots hold within its article, or, without an article, within the part of the page that holds most of it; parts that
say by their element, role or class that they are a menu, an advert or the like are left out, as their content varies too. A
form, and what only a word in class or id marks, are not where they hold the article or most of the page
(``dom.release_wrappers``).

A host of any size is aligned page by page in the tasks that read them. Only counts by host, reference and node are shuffled; the
references are sent to every task only if they are measured to be few, and else joined by host, where Spark splits a
large host's pages as it runs.
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.dom import PROSE, Node, Part, blocks, match, parse, parts, preorder, release_wrappers
from gleaner.session import Workspace, broadcast_if_light

#: A node is template when at least so many pages have it, and this share of them with the same text. Fewer pages don't tell
#: what varies.
LEAST_PAGES, SAME = 5, 0.9
#: Reference pages of a host: those of its most frequent layouts.
REFERENCES = 3
#: Elements whose kinds, with their classes, are a page's layout.
LAYOUT_TAG = (
    r"(?i)<((?:div|section|table|ul|ol|dl|form|main|article|aside|nav|header|footer|h[1-6])(?=[\s/>])"
    r"(?:\s++class\s*+=\s*+(?:\"[^\"<>]*+\"|'[^'<>]*+'|[^\s\"'<>]++))?+)"
)
#: The part of a page that is its main text holds at least this share of the text of what it stands in.
MAIN_SHARE = 0.8
LIGHT_HOSTS, LIGHT_BYTES = 200_000, 64 << 20
KEPT_WRAPPERS = 256


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty for null or a URL without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def layout(html: Column) -> Column:
    """A digest of the kinds of structural elements that a page has, with a class that comes first, however often and in whatever order."""
    kinds = F.regexp_extract_all(html, F.lit(LAYOUT_TAG), F.lit(1))
    return F.md5(F.array_join(F.array_sort(F.array_distinct(kinds)), "\n"))


class _Reference:
    """A reference page as a tree of parts, the numbers of its nodes, and those of them that are constant."""

    def __init__(self, layout: str, html: str, constant: list[int] | None):
        self.layout, self.html, self.tree, self.constant = layout, html, parts(parse(html)), frozenset(constant or ())
        self.number = {id(p): i for i, p in enumerate(preorder(self.tree))}


class _References:
    """Parsed reference pages of the hosts seen last in a task."""

    def __init__(self):
        self.held: OrderedDict = OrderedDict()

    def get(self, host: str, references: list[dict]) -> list[_Reference]:
        if host not in self.held:
            self.held[host] = [_Reference(r["layout"], r["html"], r.get("constant")) for r in references]
            if len(self.held) > KEPT_WRAPPERS:
                self.held.popitem(last=False)
        return self.held[host]


def aligned(page: Part, layout: str | None, references: list[_Reference]) -> tuple[int, list[tuple[Part, Part]]]:
    """(place of the page's reference, pairs of its nodes and the page's): that of the same layout, else the best match, the first of equal ones."""
    for i, r in enumerate(references):
        if r.layout == layout:
            return i, match(r.tree, page)[1]
    found = [match(r.tree, page) for r in references]
    best = max(range(len(found)), key=lambda i: (found[i][0], -i))
    return best, found[best][1]


def _align_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _References()
    for batch in batches:
        seen: Counter = Counter()
        same: Counter = Counter()
        for name, html, kind, listed in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "layout", "references"))):
            references = held.get(name, listed)
            if any(html == r.html for r in references):
                continue  # a reference itself and copies of it say nothing of what varies
            i, pairs = aligned(parts(parse(html)), kind, references)
            for p, q in pairs:
                key = name, references[i].layout, references[i].number[id(p)]
                seen[key] += 1
                same[key] += p.text == q.text
        columns = [[k[0] for k in seen], [k[1] for k in seen], [k[2] for k in seen], list(seen.values()), [same[k] for k in seen]]
        types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "layout", "node", "seen", "same"])


def _lengths(root: Node) -> dict[Node, int]:
    """Characters of the text of each node below ``root`` that is neither aside nor template, white space as one blank."""
    order, length = [root], {}
    for node in order:
        order.extend(n for n in node.items if isinstance(n, Node) and not n.aside and not n.template)
    for node in reversed(order):
        own = 0 if node.fixed else len(" ".join("".join(x if isinstance(x, str) else "\n" for x in node.items).split()))
        length[node] = own + sum(length[n] for n in node.items if isinstance(n, Node) and n in length)
    return length


def _below(root: Node, test) -> list[Node]:
    """The outermost nodes below ``root`` that pass, outside of what isn't main text."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.aside:
            continue
        if test(node):
            out.append(node)
        else:
            todo.extend(n for n in reversed(node.items) if isinstance(n, Node))
    return out


def _main(root: Node) -> list[Node]:
    """Where a page's main text stands: its articles, else its main element, else the part with most of the text."""
    mains = _below(root, lambda n: n.tag == "main") or [root]
    articles = [a for m in mains for a in _below(m, lambda n: n.tag == "article")]
    if articles:
        return articles
    if mains != [root]:
        return mains
    node, length = root, _lengths(root)
    while True:
        inner = [n for n in node.items if n in length and not n.inline]
        if not inner or max(length[n] for n in inner) < MAIN_SHARE * max(1, length[node]):
            return [node]
        best = max(inner, key=length.__getitem__)
        if best.tag in PROSE or any(n.tag in PROSE and n is not best for n in inner):
            return [node]
        node = best


def main_text(html: str, layout: str | None = None, references: list[_Reference] | None = None) -> str:
    """The main text of a page: its blocks joined by line ends."""
    page = parse(html)
    release_wrappers(page)
    if references and any(r.constant for r in references):
        i, pairs = aligned(parts(page), layout, references)
        for p, q in pairs:
            if references[i].number[id(p)] in references[i].constant and p.text == q.text and p.text:
                for node in q.nodes:
                    node.fixed = node.tag not in PROSE
                    node.template = not any(isinstance(n, Node) for n in node.items)
    main = _main(page)
    # Paragraphs and headings within the main part are its own even where all pages share them.
    text = "\n".join(blocks(main, lambda n: not n.aside and (not n.template or n.tag in PROSE), fixed=False))
    return text or "\n".join(blocks(main, lambda n: not n.aside))


def _extract_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _References()
    for batch in batches:
        texts = []
        for name, html, kind, listed in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "layout", "references"))):
            known = held.get(name, listed) if any(r["constant"] for r in listed) else None
            texts.append(main_text(html, kind, known))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars in code points.

    A null html is the empty page and has an empty text. Pages without a host in their URL are a host of their own. A host of
    fewer than six different pages has no template, and its pages are judged by their elements alone; so is broken
    markup, of which everything that can be read is. A page whose main part is template as a whole keeps it. Repeated
    rows are pages like others. An empty table gives an empty result; other columns are not read. Pages of
    any size are matched in full; the time grows with the product of their unlike parts.
    """
    work = Workspace(pages.sparkSession, "html-wrapper")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), host(F.col("url").cast("string")).alias("host"), html.alias("html"))
    rows = rows.withColumn("layout", layout(F.col("html")))
    key = F.xxhash64("page_id", "url", "html")
    full = F.when(F.col("html").rlike(r"\S"), key)
    counted = rows.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.min(full).alias("key"))
    order = Window.partitionBy("host").orderBy(F.col("key").isNull(), F.col("pages").desc(), "layout")
    first = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= REFERENCES)
    first = work.write(first.where("key is not null or place = 1").select("host", "layout", "place", "key"), "first")
    picked, _ = broadcast_if_light(first.withColumnRenamed("key", "picked"), LIGHT_HOSTS, LIGHT_BYTES, F.octet_length("host") + 56)
    found = rows.withColumn("key", full).join(picked, ["host", "layout"]).where(F.col("key").eqNullSafe(F.col("picked")))
    references = found.groupBy("host", "place", "layout").agg(F.min("html").alias("html"))
    references = work.write(references, "references")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "layout", "html"))), lambda r: F.struct(r["layout"].alias("layout"), r["html"].alias("html")))
    by_host = work.write(references.groupBy("host").agg(listed.alias("references")), "by-host")  # REFERENCES at most
    size = lambda c: F.aggregate(c, F.lit(0), lambda t, r: t + F.octet_length(r["html"]) + 64)
    light, _ = broadcast_if_light(by_host, LIGHT_HOSTS, LIGHT_BYTES, size("references"))

    counts = rows.select("host", "html", "layout").join(light, "host").mapInArrow(_align_task, "host string, layout string, node int, seen bigint, same bigint")
    nodes = counts.groupBy("host", "layout", "node").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    template = nodes.where((F.col("seen") >= LEAST_PAGES) & (F.col("same") >= F.col("seen") * SAME))
    template = template.groupBy("host", "layout").agg(F.sort_array(F.collect_list("node")).alias("constant"))  # of one page's nodes
    wrappers = references.join(template, ["host", "layout"], "left")
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("place", "layout", "html", "constant"))),
        lambda r: F.struct(r["layout"].alias("layout"), r["html"].alias("html"), r["constant"].alias("constant")),
    )
    wrappers = work.write(wrappers.groupBy("host").agg(listed.alias("references")), "wrappers")
    light, _ = broadcast_if_light(wrappers, LIGHT_HOSTS, LIGHT_BYTES, size("references"))
    texts = rows.join(light, "host").select("page_id", "url", "host", "html", "layout", "references")
    texts = texts.mapInArrow(_extract_task, "page_id bigint, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
