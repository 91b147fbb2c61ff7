"""Visible text of HTML pages, laid out.

A small tree builder reads tags as the HTML standard does, closes what an opening
tag implies (a list item ends the one before it, a block ends an open paragraph,
a cell ends a cell) and drops end tags that match nothing.  Elements that are
never shown (scripts, styles, heads, templates), that carry ``hidden``, whose inline
style says ``display: none`` or ``visibility: hidden``, and the bodies of closed
``details`` and ``dialog`` elements are skipped with all they hold, at any depth.
The renderer then emits every visible character: blocks on lines of their own,
paragraphs and headings between blank lines, list items with marks and
indentation, preformatted text unchanged, and table rows with cells padded to
the width of their column.

Time and memory are linear in the page: every character is read once, open
elements are found by their tag, not by walking up, and nothing recurses.  Two
bounds concern blanks only: indentation stops growing at ``MOST_INDENT`` columns and
cells are padded to ``MOST_WIDTH`` at most.

Edge cases: null and empty pages give an empty text; text outside any element
is shown; unclosed elements end with the page; a tag or comment without an end
swallows the rest of the page, as in browsers; spanning cells take one column
each; repeated rows are rendered each; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTR_NAME = re.compile(r"=?[^\s/>=]*")
_BLANK = re.compile(r"\s*")
_BARE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile("--!?>")
_HIDING = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))")
_SPACE = re.compile(r"[ \t\n\r\f]+")

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg math datalist select title meta link base param area".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog div dt fieldset figcaption footer form header hgroup legend li main menu nav search section summary tbody thead tfoot tr td th caption textarea".split())
ENDS_P = BLOCK - frozenset("html body tbody thead tfoot tr td th caption legend summary li dd dt textarea".split())
# an opening tag closes these, looking up to the nearest of the second set
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
SCOPES = frozenset("table td th caption html template".split())
MOST_INDENT, MOST_WIDTH = 64, 80


class Node:
    __slots__ = ("tag", "kids", "start", "shut")

    def __init__(self, tag: str, start: int | None = None, shut: bool = False) -> None:
        self.tag, self.kids, self.start, self.shut = tag, [], start, shut


def read_attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag from behind its name, and the place after its ``>``; -1 if the page ends before."""
    found: dict[str, str] = {}
    n = len(html)
    while True:
        at = _GAP.match(html, at).end()
        if at >= n:
            return found, -1
        if html[at] == ">":
            return found, at + 1
        name = _ATTR_NAME.match(html, at)
        at = _BLANK.match(html, name.end()).end()
        value = ""
        if at < n and html[at] == "=":
            at = _BLANK.match(html, at + 1).end()
            if at < n and html[at] in "\"'":
                end = html.find(html[at], at + 1)
                if end < 0:
                    return found, -1
                value, at = html[at + 1 : end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare.group(), bare.end()
        found.setdefault(name.group().lower(), value)


def skip_markup(html: str, at: int) -> int:
    """The place after a comment, declaration or instruction at ``at``; -1 if it has no end."""
    if html.startswith("<!--", at):
        for short in ("<!-->", "<!--->"):
            if html.startswith(short, at):
                return at + len(short)
        end = _COMMENT_END.search(html, at + 4)
        return end.end() if end else -1
    end = html.find(">", at)
    return end + 1 if end >= 0 else -1


class _Open:
    """The open elements, with their places by tag."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.scopes = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> None:
        """Close the element at ``depth`` and all in it."""
        for node in self.stack[depth:]:
            self.places[node.tag].pop()
            if node.tag in SCOPES:
                self.scopes.pop()
        del self.stack[depth:]

    def nearest(self, tag: str) -> int:
        """Place of the innermost element of a tag; 0 if none is open."""
        return places[-1] if (places := self.places.get(tag)) else 0

    def reach(self, tag: str) -> int:
        """As ``nearest``, but 0 where a scope lies between."""
        at = self.nearest(tag)
        return at if not self.scopes or at >= self.scopes[-1] else 0

    def implied(self, tag: str) -> int:
        """Place of the outermost element that an opening ``tag`` ends; 0 if there is none."""
        ends, stops = IMPLIED[tag]
        floor = max(self.nearest(t) for t in stops)
        above = [places[i] for t in ends if (places := self.places.get(t)) and (i := bisect_right(places, floor)) < len(places)]
        return min(above, default=0)


def build_tree(html: str) -> tuple[Node, str]:
    """The tree of visible elements and texts, and the page's title."""
    root = Node("html")
    opened = _Open(root)
    title = None
    hidden = 0  # size of the stack at which everything is hidden, 0: nothing is
    at, n = 0, len(html)

    def close(depth: int) -> None:
        nonlocal hidden
        opened.close(depth)
        if hidden and len(opened.stack) < hidden:
            hidden = 0

    def add(text: str) -> None:
        if text and not hidden and not opened.stack[-1].shut:
            opened.stack[-1].kids.append(unescape(text) if "&" in text else text)

    while at < n:
        mark = html.find("<", at)
        if mark < 0:
            add(html[at:])
            break
        add(html[at:mark])
        after = html[mark + 1 : mark + 2]
        closing = after == "/"
        name = _NAME.match(html, mark + 1 + closing)
        if name is None:
            if after in ("!", "?") or closing and mark + 2 < n:
                at = skip_markup(html, mark)
                if at < 0:
                    break
            else:
                add("<")
                at = mark + 1
            continue
        attrs, at = read_attributes(html, name.end())
        if at < 0:
            break
        tag = name.group().lower()
        if closing:
            place = opened.nearest(tag) if tag in SCOPES or tag in ("tr", "tbody", "thead", "tfoot") else opened.reach(tag)
            if place:
                close(place)
            continue
        if tag == "html":
            continue
        if tag in ENDS_P and (place := opened.reach("p")):
            close(place)
        if tag in IMPLIED and (place := opened.implied(tag)):
            close(place)
        top = opened.stack[-1]
        unseen = tag in UNSEEN or "hidden" in attrs or bool(_HIDING.search(unescape(attrs.get("style", "")))) or tag == "input" or (tag == "dialog" and "open" not in attrs) or (top.shut and tag != "summary")
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            inner = html[at : end.start() if end else n]
            if tag == "title" and title is None:
                title = _SPACE.sub(" ", unescape(inner)).strip()
            elif tag == "textarea" and not hidden and not unseen:
                node = Node(tag)
                node.kids.append(unescape(inner))
                top.kids.append(node)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if not hidden and not unseen and tag in ("br", "hr", "wbr"):
                top.kids.append(Node(tag))
            continue
        number = attrs.get("start" if tag == "ol" else "value", "") if tag in ("ol", "li") else ""
        node = Node(tag, int(number) if re.fullmatch(r"-?\d{1,9}", number) else None, tag == "details" and "open" not in attrs)
        if not hidden and not unseen:
            top.kids.append(node)
        opened.push(node)
        if unseen and not hidden:
            hidden = len(opened.stack)
    return root, title or ""


_RAW_END = {tag: re.compile(rf"</{tag}(?:>|[\s/][^>]*(?:>|\Z))", re.I) for tag in RAW}


class Layout:
    """Lines under construction: pending inline text, and how much space the next block wants."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.blocks = self.items = self.rows = 0

    def flush(self, prefix: str, mark: list[str]) -> bool:
        """Write out the pending text; its first line takes the mark of a list item that waits for one."""
        text = "".join(self.inline)
        self.inline = []
        out = [_SPACE.sub(" ", part.replace("\n", " ")).strip(" ") for part in text.split("\x00")]
        while out and not out[-1]:
            out.pop()
        out = out[next((i for i, line in enumerate(out) if line), len(out)) :]
        if not out:
            return False
        self.blocks += 1
        for line in out:
            self.lines.append(((mark.pop() if mark else prefix) + line).rstrip(" "))
        return True

    def gap(self) -> None:
        if self.lines and self.lines[-1]:
            self.lines.append("")


def _flat(node: Node) -> str:
    """The text of a cell on one line."""
    parts: list[str] = []
    todo = [iter(node.kids)]
    edges = [""]
    while todo:
        kid = next(todo[-1], None)
        if kid is None:
            todo.pop()
            parts.append(edges.pop())
        elif isinstance(kid, str):
            parts.append(kid)
        elif kid.tag != "wbr":
            edges.append(" " if kid.tag in BLOCK or kid.tag == "br" else "")
            parts.append(edges[-1])
            todo.append(iter(kid.kids))
    return _SPACE.sub(" ", "".join(parts)).strip(" ")


def _plain(node: Node) -> str:
    """Preformatted text."""
    parts: list[str] = []
    todo = [iter(node.kids)]
    while todo:
        kid = next(todo[-1], None)
        if kid is None:
            todo.pop()
        elif isinstance(kid, str):
            parts.append(kid)
        elif kid.tag == "br":
            parts.append("\n")
        else:
            todo.append(iter(kid.kids))
    return "".join(parts)


def _cells(table: Node) -> tuple[list[str], list[list[str]], list[Node]]:
    """Captions, rows of cells, and what stands in the table outside of both."""
    captions, rows, loose = [], [], []
    todo: list[tuple] = [(iter(table.kids), None)]
    while todo:
        kids, row = todo[-1]
        kid = next(kids, None)
        if kid is None:
            todo.pop()
        elif isinstance(kid, str):
            if kid.strip():
                loose.append(Node("span"))
                loose[-1].kids.append(kid)
        elif kid.tag == "caption":
            captions.append(_flat(kid))
        elif kid.tag == "tr":
            rows.append([])
            todo.append((iter(kid.kids), rows[-1]))
        elif kid.tag in ("td", "th"):
            if row is None:
                row = []
                rows.append(row)
                todo[-1] = (kids, row)
            row.append(_flat(kid))
        elif kid.tag in ("tbody", "thead", "tfoot"):
            todo.append((iter(kid.kids), None))
        else:
            loose.append(kid)
    return captions, [r for r in rows if any(r)], loose


def render(root: Node) -> Layout:
    """The lines of a tree.

    ``block`` yields the blocks inside it, and the loop at the end runs them on a
    stack of its own, so that depth is no matter.
    """
    out = Layout()

    def deeper(prefix: str, by: int) -> str:
        return prefix + " " * min(by, max(0, MOST_INDENT - len(prefix)))

    def table(node: Node, prefix: str, mark: list[str]):
        captions, rows, loose = _cells(node)
        for kid in loose:  # what a table may not hold is shown before it
            yield block(kid, prefix, mark)
            out.flush(prefix, mark)
        out.lines += [(mark.pop() if mark else prefix) + c for c in captions if c]
        widths: list[int] = []
        for r in rows:
            widths += [0] * (len(r) - len(widths))
            for i, c in enumerate(r):
                widths[i] = min(MOST_WIDTH, max(widths[i], len(c)))
        for r in rows:
            out.lines.append(((mark.pop() if mark else prefix) + " | ".join(c.ljust(widths[i]) for i, c in enumerate(r))).rstrip(" "))
        out.rows += len(rows)
        out.blocks += bool(rows)

    def block(node: Node, prefix: str, mark: list[str]):
        number = 1 if node.start is None else node.start
        for kid in node.kids:
            if isinstance(kid, str):
                out.inline.append(kid.replace("\x00", ""))
                continue
            tag = kid.tag
            if tag == "br":
                out.inline.append("\x00")
            elif tag == "wbr":
                continue
            elif tag not in BLOCK:
                yield block(kid, prefix, mark)
            else:
                out.flush(prefix, mark)
                spaced = tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li")
                if spaced:
                    out.gap()
                if tag == "hr":
                    out.lines.append((mark.pop() if mark else prefix) + "---")
                elif tag in ("pre", "textarea"):
                    if text := _plain(kid).strip("\n"):
                        out.lines += [((mark.pop() if mark else prefix) + x).rstrip(" ") for x in text.split("\n")]
                        out.blocks += 1
                elif tag == "table":
                    yield table(kid, prefix, mark)
                elif tag == "li":
                    if node.tag == "ol":
                        number = number if kid.start is None else kid.start
                        bullet = f"{number}. "
                        number += 1
                    else:
                        bullet = "- "
                    out.items += 1
                    inner, own = deeper(prefix, len(bullet)), [prefix + bullet]
                    yield block(kid, inner, own)
                    out.flush(inner, own)
                else:
                    inner = deeper(prefix, 2) if tag in ("blockquote", "dd") else prefix
                    yield block(kid, inner, mark)
                    out.flush(inner, mark)
                if spaced:
                    out.gap()

    running = [block(root, "", [])]
    while running:
        inside = next(running[-1], None)
        if inside is None:
            running.pop()
        else:
            running.append(inside)
    out.flush("", [])
    while out.lines and not out.lines[-1]:
        out.lines.pop()
    return out


def extract(html: str | None) -> tuple[str, str, int, int, int]:
    """title, text, number of blocks, of list items and of table rows."""
    root, title = build_tree(html or "")
    out = render(root)
    return title, "\n".join(out.lines), out.blocks, out.items, out.rows


def render_pages(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, title, text, n_chars, n_blocks, n_items, n_rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = [extract(x) for x in part.column(1).to_pylist()]
                rows = [(t, x, len(x), b, i, r) for t, x, b, i, r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]], names=["page_id", "title", "text", "n_chars", "n_blocks", "n_items", "n_rows"])

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(scan, "page_id long, title string, text string, n_chars long, n_blocks int, n_items int, n_rows int")
