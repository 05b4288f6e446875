"""The HTML tree builder: one Python pass per page, everything after it is Column expressions.

Tags nest as they are written: no end tag is implied, an end tag closes the nearest open element of
its name or is ignored, void elements have no children, and the end of the page closes the rest.
Strings of script, style, template, rt and rp are not part of other elements' text.

``dom(html)`` yields a struct of ``elements`` (those that any operator asks for, in document order,
with sizes of their subtrees) and ``meta`` candidates.  For walks, an element carries the number of
the innermost ancestor that ends a content walk (``stop1``) or a heading-cluster walk (``stop2``):
a walk rooted at r reaches it iff that number is below r's.

Rows and cells nest where they are not closed, so the texts of a table's rows can add up to the square
of the page or more.  They are not copied: the first element, the document, has an index of intervals
(``tables``), cells as ranges of one array of strings, rows as ranges of cells, and a table is a range
of rows; ``chars`` is how long its rows' texts would be, a row's ``bytes`` how long its own in UTF-8.
"""

from __future__ import annotations

import re
import time
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.pandas.functions import arrow_udf

from siftwell.functions.batches import mapped

# Tag sets, roles, class names and labels.
NOISE_TAGS = {"script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "form", "head", "button", "svg"}
CONTENT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "li", "blockquote", "pre", "code"}
CONTAINER_TAGS = {"article", "main", "section", "div", "td"}
INLINE_TAGS = {"a", "strong", "em", "b", "i", "code", "span", "small"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OWN_STRINGS = {"script", "style", "template", "rt", "rp"}
NOISE_ROLES = {"navigation", "menu", "menubar", "banner", "complementary", "search"}
NOISE_LABELS = {"navigation", "breadcrumb", "table of contents"}
NOISE_CLASSES = re.compile(
    r"\b(skip-link|skip-to|breadcrumb|cookie-banner|cookie-notice|advertisement|ad-container|popup|modal-overlay|topbar|toolbar)\b", re.IGNORECASE
)
META_NAMES = ("description", "author")
META_PROPERTIES = (
    "og:title", "og:description", "og:site_name", "article:author", "article:published_time", "article:modified_time",
)

RANGE = "first:int,last:int"
TABLES = f"struct<strings:array<string>,cells:array<struct<{RANGE}>>,rows:array<struct<{RANGE},is_header:boolean,bytes:bigint>>>"
ELEMENT = (
    "struct<pre:int,end:int,depth:int,tag:string,role:string,noise:boolean,text:string,text_len:int,link_len:int,"
    f"weight:double,stop1:int,stop2:int,code_lang:string,rows:struct<{RANGE},chars:bigint>,tables:{TABLES}>"
)
META_FIELDS = ("title", "lang", "canonical", *(f"name:{n}" for n in META_NAMES), *(f"property:{n}" for n in META_PROPERTIES))
META = "struct<" + ",".join(f"`{n}`:string" for n in META_FIELDS) + ">"
DOM = f"struct<elements:array<{ELEMENT}>,meta:{META},ms:double>"

_LANGUAGE = re.compile(r"language-(\w+)")
_ASCII_SPACE = " \n\t\f\r"


class Element:
    __slots__ = ("attrs", "depth", "end", "link", "noise", "parent", "pre", "root", "s0", "s1", "stop1", "stop2", "strip", "tag", "weight")

    def __init__(self, pre: int, tag: str, attrs: dict[str, str], parent: Element | None, s0: int):
        self.pre, self.tag, self.attrs, self.parent, self.s0 = pre, tag, attrs, parent, s0
        self.end, self.s1, self.depth = pre, s0, parent.depth + 1 if parent else 0
        self.noise = bool(attrs) and is_noise(attrs)
        self.stop1 = self.stop2 = -1
        if parent:
            p = parent
            walls1 = p.tag in NOISE_TAGS or p.tag in CONTENT_TAGS or p.tag == "table" or p.noise
            walls2 = p.tag in NOISE_TAGS or p.tag in CONTENT_TAGS or p.noise
            self.stop1, self.stop2 = p.pre if walls1 else p.stop1, p.pre if walls2 else p.stop2
        # the innermost element, this one included, that a walk may start at
        self.root = pre if tag in CONTAINER_TAGS or tag == "body" or not parent or attrs.get("role") == "main" else parent.root
        self.link = self.strip = 0
        self.weight = 0.0


def is_noise(attrs: dict[str, str]) -> bool:
    """Whether role, class, id or aria-label mark an element as noise."""
    if attrs.get("role") in NOISE_ROLES or attrs.get("aria-label", "").lower() in NOISE_LABELS:
        return True
    names = " ".join(attrs.get("class", "").split()) + " " + attrs.get("id", "")
    return len(names) > 1 and NOISE_CLASSES.search(names) is not None


class TreeBuilder(HTMLParser):
    """Elements in document order, and all strings in document order with the elements' ranges."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = Element(0, "[document]", {}, None, 0)
        self.elements = [self.root]
        self.open = [self.root]
        self.pending: list[str] = []
        self.strings: list[tuple[str, int, bool]] = []  # stripped, unstripped length, plain
        self.closed_voids: Counter[str] = Counter()
        self.open_tags: Counter[str] = Counter()

    def _flush(self) -> None:
        if not self.pending:
            return
        text, self.pending = "".join(self.pending), []
        if not text.strip(_ASCII_SPACE) and not (self.open_tags["pre"] or self.open_tags["textarea"]):
            text = "\n" if "\n" in text else " "
        plain = not any(self.open_tags[tag] for tag in OWN_STRINGS)
        self.strings.append((text.strip(), len(text), plain))

    def _close(self, element: Element) -> None:
        element.end, element.s1 = len(self.elements) - 1, len(self.strings)

    def handle_starttag(self, tag, attrs):
        self._open(tag, attrs)
        if tag in VOID_TAGS:
            self._pop(tag)
            self.closed_voids[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._open(tag, attrs)
        self.handle_endtag(tag)

    def _open(self, tag, attrs) -> None:
        self._flush()
        element = Element(len(self.elements), tag, {k: v or "" for k, v in attrs}, self.open[-1], len(self.strings))
        self.elements.append(element)
        self.open.append(element)
        self.open_tags[tag] += 1

    def _pop(self, tag: str) -> None:
        self._flush()
        if not self.open_tags[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                for element in self.open[i:]:
                    self._close(element)
                    self.open_tags[element.tag] -= 1
                del self.open[i:]
                return

    def handle_endtag(self, tag):
        if self.closed_voids[tag]:
            self.closed_voids[tag] -= 1
        else:
            self._pop(tag)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_charref(self, name):
        try:
            code = int(name[1:].lstrip("xX"), 16) if name[:1] in "xX" else int(name)
        except ValueError:
            code = -1
        text = ""
        if 0 <= code < 256:
            text = bytes([code]).decode("windows-1252", "ignore")
        if not text and 0 <= code <= 0x10FFFF and not 0xD800 <= code < 0xE000:
            text = chr(code)
        self.pending.append(text or "�")

    def handle_entityref(self, name):
        self.pending.append(html5.get(f"{name};", f"&{name}"))

    def _break(self, _data=None) -> None:
        self._flush()

    handle_comment = handle_decl = handle_pi = _break

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._flush()
            self.pending.append(data[6:])
        self._flush()

    def finish(self) -> None:
        self.close()
        self._flush()
        for element in self.open:
            self._close(element)
        strings, sums, lengths = self.strings, [0], [0]
        for stripped, length, plain in strings:
            sums.append(sums[-1] + len(stripped) * plain)
            lengths.append(lengths[-1] + length * plain)
        for e in reversed(self.elements):
            e.strip = sums[e.s1] - sums[e.s0]
            if e.parent:
                e.parent.weight += e.weight + (0.5 if e.tag in INLINE_TAGS else 1.0)
                e.parent.link += e.link + (lengths[e.s1] - lengths[e.s0] if e.tag == "a" else 0)

    def text(self, e: Element, separator: str = " ") -> str:
        own = e.tag in OWN_STRINGS
        return separator.join(s for s, _, plain in self.strings[e.s0 : e.s1] if s and (plain or own))

    def below(self, e: Element) -> list[Element]:
        return self.elements[e.pre + 1 : e.end + 1]


def parse(html: str | None) -> TreeBuilder:
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.finish()
    return builder


def utf8_length(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


class TableIndex:
    """Strings, cells and rows (those with text in a cell) of a page, each a range of the one before."""

    def __init__(self, tree: TreeBuilder):
        kept = [bool(s) and plain for s, _, plain in tree.strings]
        self.strings = [s for (s, _, _), k in zip(tree.strings, kept) if k]
        at = list(accumulate(kept, initial=0))
        cells = [e for e in tree.elements if e.tag in ("td", "th")]
        self.cells = [(at[e.s0], at[e.s1]) for e in cells]
        pres = [e.pre for e in cells]
        heads = list(accumulate((e.tag == "th" for e in cells), initial=0))
        filled = list(accumulate((last > first for first, last in self.cells), initial=0))
        # lengths with the separators between strings, and between cells
        chars = list(accumulate((len(x) + 1 for x in self.strings), initial=0))
        texts = list(accumulate((max(0, chars[last] - chars[first] - 1) + 3 for first, last in self.cells), initial=0))
        sizes = list(accumulate((utf8_length(x) + 1 for x in self.strings), initial=0))
        bytes_ = list(accumulate((max(0, sizes[last] - sizes[first] - 1) + 3 for first, last in self.cells), initial=0))
        self.rows, self.pres, self.chars = [], [], [0]
        for e in tree.elements:
            if e.tag == "tr":
                first, last = bisect_right(pres, e.pre), bisect_right(pres, e.end)
                if filled[last] > filled[first]:
                    self.rows.append((first, last, e.parent.tag == "thead" or heads[last] > heads[first], bytes_[last] - bytes_[first] - 3))
                    self.pres.append(e.pre)
                    self.chars.append(self.chars[-1] + texts[last] - texts[first] - 3)

    def of(self, table: Element) -> dict:
        first, last = bisect_right(self.pres, table.pre), bisect_right(self.pres, table.end)
        return {"first": first, "last": last, "chars": self.chars[last] - self.chars[first]}

    def struct(self) -> dict:
        cells = [{"first": a, "last": b} for a, b in self.cells]
        return {"strings": self.strings, "cells": cells, "rows": [{"first": a, "last": b, "is_header": h, "bytes": n} for a, b, h, n in self.rows]}


def _code_lang(tree: TreeBuilder, pre: Element) -> str | None:
    names = [pre.attrs.get("class", "")] + [c.attrs.get("class", "") for c in tree.below(pre) if c.tag == "code"][:1]
    found = _LANGUAGE.search(" ".join(" ".join(names).split()))
    return found[1] if found else None


def _meta(tree: TreeBuilder) -> dict[str, str | None]:
    """First candidates of every field, stripped; an absent one is null."""
    found: dict[str, str | None] = dict.fromkeys(META_FIELDS)
    for e in tree.elements:
        if e.tag == "title" and found["title"] is None:
            found["title"] = tree.text(e, "")
        elif e.tag == "html" and found["lang"] is None:
            found["lang"] = e.attrs.get("lang", "").strip() if e.attrs.get("lang") else ""
            found["lang"] = found["lang"] if e.attrs.get("lang") else None
        elif e.tag == "link" and found["canonical"] is None and "canonical" in e.attrs.get("rel", "").split():
            found["canonical"] = e.attrs.get("href", "")
        elif e.tag == "meta":
            for attr, names in (("name", META_NAMES), ("property", META_PROPERTIES)):
                key = f"{attr}:{e.attrs.get(attr)}"
                if e.attrs.get(attr) in names and found[key] is None:
                    found[key] = e.attrs.get("content", "").strip()
    return found


def page(html: str | None) -> dict:
    """The ``dom`` struct of one page; ``ms`` is how long it took."""
    began = time.perf_counter()
    tree, out = parse(html), []
    tables = TableIndex(tree) if any(e.tag == "table" for e in tree.elements) else None
    for e in tree.elements:
        content, table = e.tag in CONTENT_TAGS, e.tag == "table"
        if content and e.root <= e.stop2:
            continue  # inside a content element that every walk takes whole; its text is in that one's
        if not (content or table or e.tag in CONTAINER_TAGS or e.tag in ("[document]", "body") or e.attrs.get("role") == "main"):
            continue
        out.append(
            {
                "pre": e.pre, "end": e.end, "depth": e.depth, "tag": e.tag, "role": e.attrs.get("role"), "noise": e.noise,
                "text": tree.text(e) if content else None, "text_len": e.strip, "link_len": e.link, "weight": e.weight,
                "stop1": e.stop1, "stop2": e.stop2, "code_lang": _code_lang(tree, e) if e.tag == "pre" else None, "rows": tables.of(e) if table else None,
                "tables": tables.struct() if tables and not e.pre else None,
            }
        )
    return {"elements": out, "meta": _meta(tree), "ms": (time.perf_counter() - began) * 1000}


_RANGE = [("first", pa.int32()), ("last", pa.int32())]
_TABLES_TYPE = pa.struct(
    [("strings", pa.list_(pa.string())), ("cells", pa.list_(pa.struct(_RANGE))), ("rows", pa.list_(pa.struct([*_RANGE, ("is_header", pa.bool_()), ("bytes", pa.int64())])))]
)
_ELEMENT_TYPE = pa.struct(
    [
        ("pre", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("role", pa.string()), ("noise", pa.bool_()),
        ("text", pa.string()), ("text_len", pa.int32()), ("link_len", pa.int32()), ("weight", pa.float64()), ("stop1", pa.int32()), ("stop2", pa.int32()),
        ("code_lang", pa.string()), ("rows", pa.struct([*_RANGE, ("chars", pa.int64())])), ("tables", _TABLES_TYPE),
    ]
)
_DOM_TYPE = pa.struct([("elements", pa.list_(_ELEMENT_TYPE)), ("meta", pa.struct([(n, pa.string()) for n in META_FIELDS])), ("ms", pa.float64())])


def _pages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from mapped(batches, page, _DOM_TYPE)


def dom(html: Column) -> Column:
    """The parsed page, as one column to be materialised once per row."""
    return arrow_udf(_pages, DOM)(html)
