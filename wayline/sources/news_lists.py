"""Lists of news in HTML pages: one reader for all sources, which are told apart by a table of paths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, elements whose text isn't shown, elements that don't part words, and elements that a new one of the same row ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template noscript".split())
INLINE = frozenset("a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup u".split())
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What such an element looks for its own kind in: not beyond these.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"li", "td", "th", "div", "article", "section", "body"}, "option": {"select"}}
FIELDS = ["title", "date", "link", "lead"]
_STEP = re.compile(r"(?P<tag>[a-z][a-z0-9]*|\*)?(?P<rest>(?:[.#][\w-]+)*)", re.I)


class Node(NamedTuple):
    """An element: its place among all, its parent's, its tag and attributes, where its texts begin; ``end`` is put later."""

    parent: int
    tag: str
    attrs: dict[str, str]
    first: int


class Page(HTMLParser):
    """The elements of a page in order, each with its parent, and its shown texts. Any markup is read; what isn't closed ends with its parent."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.ends: list[int] = []
        self.texts: list[str] = []
        self.open: list[int] = []
        self.feed(html)
        self.close()
        self._cut(0)

    def _cut(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.ends[i] = len(self.texts)
        if any(self.nodes[i].tag not in INLINE for i in self.open[depth:]):
            self.texts.append(" ")
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        for depth in range(len(self.open) - 1, -1, -1):
            held = self.nodes[self.open[depth]].tag
            if held in ENDS.get(tag, ()):
                self._cut(depth)
            elif held in SCOPE.get(tag, ()):
                break
        if tag not in INLINE:
            self.texts.append(" ")
        self.nodes.append(Node(self.open[-1] if self.open else -1, tag, {k: v or "" for k, v in attrs}, len(self.texts)))
        self.ends.append(len(self.texts))
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[depth]].tag == tag:
                self._cut(depth)
                break

    def handle_data(self, data):
        if not any(self.nodes[i].tag in HIDDEN for i in self.open):
            self.texts.append(data)

    def text(self, i: int) -> str:
        return " ".join("".join(self.texts[self.nodes[i].first : self.ends[i]]).split())


class Path(NamedTuple):
    """Steps from an outer to an inner element, and the attribute to take, if it isn't the text."""

    steps: tuple[tuple[str, tuple[str, ...], str], ...]
    attr: str | None


def path(text: str) -> Path:
    """``div.card h3 a@href``: steps of tag, .class and #id, parted by blanks (any depth between), then @attribute; ``@href`` alone is the item's own."""
    where, _, attr = text.strip().partition("@")
    steps = []
    for step in where.split():
        m = _STEP.fullmatch(step)
        if not m or not step:
            raise ValueError(f"no path: {text}")
        marks = re.findall(r"[.#][\w-]+", m["rest"])
        steps.append(((m["tag"] or "*").lower(), tuple(x[1:] for x in marks if x[0] == "."), next((x[1:] for x in marks if x[0] == "#"), "")))
    if not steps and not attr:
        raise ValueError("an empty path")
    return Path(tuple(steps), attr.lower() or None)


def _fits(node: Node, step: tuple[str, tuple[str, ...], str]) -> bool:
    tag, classes, name = step
    return tag in ("*", node.tag) and (not classes or set(classes) <= set(node.attrs.get("class", "").split())) and name in ("", node.attrs.get("id"))


def found(page: Page, steps: tuple, within: int = -1) -> Iterator[int]:
    """Elements inside ``within`` (-1: the page) that the steps lead to, in order."""
    for i in range(within + 1, len(page.nodes)):
        up, k = i, len(steps) - 1
        if not _fits(page.nodes[i], steps[-1]):
            if within >= 0 and page.nodes[i].parent < within:
                return
            continue
        k -= 1
        up = page.nodes[i].parent
        while k >= 0 and up > within:
            k -= _fits(page.nodes[up], steps[k])
            up = page.nodes[up].parent
        while up > within:
            up = page.nodes[up].parent
        if k < 0 and up == within:
            yield i
        elif within >= 0 and up < within:
            return


def items(html: str, rule: dict[str, Path | None]) -> list[dict[str, str | None]]:
    """Of each item of a page the first title, date, link and lead; an item inside an item is part of it. Items without a title aren't news."""
    page, out, last = Page(html), [], -1
    for i in found(page, rule["item"].steps):
        up = page.nodes[i].parent
        while up > last:
            up = page.nodes[up].parent
        if last >= 0 and up == last:
            continue
        last, row = i, {}
        for field in FIELDS:
            p = rule[field]
            at = None if p is None else i if not p.steps else next(found(page, p.steps, i), None)
            row[field] = None if at is None else page.nodes[at].attrs.get(p.attr) if p.attr else page.text(at)
        if row["title"]:
            out.append(row)
    return out


def list_items(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page, source, n, title, date, link, lead): the items of list pages (page, source, html), numbered from 0, by the rules (source, item, title, date, link, lead) of their source.

    Rules are paths (``path``), null where a source has no such field; a source has one rule. Pages meet their rule in a join, so a source is added by a row. Null pages and pages of sources without a rule have no items.
    """
    met = pages.where("html is not null").select("page", "source", "html").join(rules.select("source", "item", *FIELDS), "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict] = {}
        for b in batches:
            out = []
            for page, source, html, *texts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rule = known.get(tuple(texts))
                if rule is None:
                    if len(known) > 1000:
                        known.clear()
                    rule = known[tuple(texts)] = {f: path(x) if x else None for f, x in zip(["item", *FIELDS], texts, strict=True)}
                out += [(page, source, n, *row.values()) for n, row in enumerate(items(html, rule))]
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page", "source", "n", *FIELDS])

    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 4]
    return met.select(F.col("page").cast("long").alias("page"), "source", "html", "item", *FIELDS).mapInArrow(run, "page long, source string, n int, title string, date string, link string, lead string")
