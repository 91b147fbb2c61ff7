"""Title and leaf text of HTML pages (Arrow batches; SQL has no HTML parser)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAKEN = frozenset(["p", "h2", "h3", "h4", "li", "td", "th", "div"])
_NESTED = _TAKEN - {"th"}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(["script", "style", "template"])
_OPEN_REFERENCE = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


class _Element:
    __slots__ = ("tag", "parts", "nested")

    def __init__(self, tag: str) -> None:
        self.tag, self.parts, self.nested = tag, [], False


class _Reader(HTMLParser):
    """Collects the texts of taken elements that hold no other taken element.

    Start tags imply no end tags: an element ends at its end tag, at that of an
    ancestor, or with the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = []
        self.found: list[_Element] = []
        self.whole: _Element | None = None
        self.title: _Element | None = None
        self.h1: _Element | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _NESTED:
            for e in self.stack:
                e.nested = True
        if tag in _VOID:
            return
        e = _Element(tag)
        self.stack.append(e)
        if tag in _TAKEN:
            self.found.append(e)
        elif tag == "body" and self.whole is None:
            self.whole = e
        elif tag == "title" and self.title is None:
            self.title = e
        elif tag == "h1" and self.h1 is None:
            self.h1 = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1].tag in _SILENT:
            return
        for e in self.stack:
            e.parts.append(data)


def _text(e: _Element | None, separator: str) -> str:
    return separator.join(x for x in (p.strip() for p in e.parts) if x) if e else ""


def read_page(html: str | None, stem: str = "", least: int = 200, closed: bool = False) -> tuple[str, str]:
    """Title (first h1, else title, else ``stem``) and leaf text (the whole body's if that is short).

    With ``closed``, a character reference without its semicolon, as a cut title has at its end, stays as it is written.
    """
    r = _Reader()
    r.feed(_OPEN_REFERENCE.sub("&amp;", html or "") if closed else html or "")
    r.close()
    title = _text(r.h1, "") if r.h1 else _text(r.title, "") if r.title else stem
    text = " ".join(t for t in (_text(e, " ") for e in r.found if not e.nested) if t)
    if len(text) < least and r.whole:
        text = _text(r.whole, " ")
    return title, text


def page_texts(pages: DataFrame, key: str, html: str, stem: str | None = None, closed: bool = False) -> DataFrame:
    """``pages`` with ``title`` and ``text`` columns (``read_page``), keyed by ``key``; other columns are dropped.

    Put cheap filters before this call: Spark can't push them below it.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_page(h, s or "", closed=closed) for h, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=[key, "title", "text"])

    narrow = pages.select(F.col(key), F.col(html), (F.col(stem) if stem else F.lit("")).alias("stem"))
    kind = dict(pages.dtypes)[key]
    return narrow.mapInArrow(scan, f"{key} {kind}, title string, text string")
