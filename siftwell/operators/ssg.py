"""Statically rendered pages: the element tuples in a page's JSON, as Markdown.

The tree is recursive and mixed, so it is rendered in Python, in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.pandas.functions import arrow_udf

from siftwell.functions.batches import mapped

# How tags are rendered.
SKIPPED = {"InlineToc", "Meta", "SandpackWithHTMLOutput"}
INLINE = {"code", "strong", "b", "em", "i", "a", "span", "small", "sup", "sub", "mark"}
INLINE_MARKS = {"code": "`", "strong": "**", "b": "**", "em": "_", "i": "_"}
HEADING_MARKS = {"h1": "#", "h2": "##", "h3": "###", "h4": "####", "h5": "####"}
MIN_CHARS = 100
ANCHOR = re.compile(r"^(#{1,3}) (.+)")
RESULT = "struct<markdown:string,title:string,meta_desc:string>"


def element(value) -> tuple[str, dict] | None:
    """(tag, properties) of an element tuple; None for anything else."""
    if isinstance(value, list) and len(value) >= 4:
        mark, tag, _, props = value[:4]
        if isinstance(mark, str) and mark[:1] == "$" and isinstance(tag, str) and (props is None or isinstance(props, dict)):
            return tag, props or {}
    return None


def inline(value) -> str:
    if isinstance(value, str):
        return value
    if found := element(value):
        tag, props = found
        mark = INLINE_MARKS.get(tag, "")
        return mark + inline(props.get("children")) + mark
    return "".join(map(inline, value)) if isinstance(value, list) else ""


def code_block(child) -> list[str]:
    if found := element(child):
        names, inner = found[1].get("className") or "", found[1].get("children")
        return ["```" + names.replace("language-", ""), inline(inner).rstrip(), "```"]
    return ["```", inline(child).rstrip(), "```"]


def blocks(value) -> list[str]:
    """Lines of a node."""
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    found = element(value)
    if not found:
        return [line for child in value for line in blocks(child)] if isinstance(value, list) else []
    tag, props = found
    child = props.get("children")
    if tag in SKIPPED:
        return []
    if tag in HEADING_MARKS:
        return [f"{HEADING_MARKS[tag]} {inline(child).strip()}"]
    if tag in INLINE or tag in ("p", "li"):
        text = inline(value if tag in INLINE else child).strip()
        return [("- " if tag == "li" else "") + text] if text else []
    if tag == "pre":
        return code_block(child)
    if tag == "blockquote":
        return ["> " + line for line in blocks(child)]
    if tag in ("hr", "br"):
        return ["---" if tag == "hr" else ""]
    return blocks(child)  # wrappers, lists and unknown tags


def single_blanks(lines: list[str]) -> list[str]:
    """Lines without blank ones that follow a blank one."""
    return [line for i, line in enumerate(lines) if line.strip() or i == 0 or lines[i - 1].strip()]


def sound(text: str) -> str:
    """Text with lone surrogates, which JSON can hold and UTF-8 can not, as question marks."""
    return text.encode("utf-8", "replace").decode()


def render(payload: str | None) -> dict | None:
    """struct(markdown, title, meta_desc) of a payload; None if it holds no page of 100 characters."""
    try:
        props = json.loads(payload)["props"]["pageProps"]
        content = props["content"]
        content = json.loads(content) if isinstance(content, str) else content
        if content is None:
            return None
        lines = single_blanks(blocks(content))
        markdown = "\n".join(lines).strip()
        if len(markdown) < MIN_CHARS:
            return None
        anchors = [m for m in map(ANCHOR.match, lines) if m]
        title = next((m[2].strip() for m in anchors if len(m[1]) == 1), None) or (anchors[0][2].strip() if anchors else "")
        about = props.get("description") or ""
        return {"markdown": sound(markdown), "title": sound(title), "meta_desc": sound(about if isinstance(about, str) else json.dumps(about))}
    except (KeyError, TypeError, ValueError, AttributeError, RecursionError):
        return None


def _rendered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("markdown", pa.string()), ("title", pa.string()), ("meta_desc", pa.string())])
    yield from mapped(batches, lambda p: render(p) if p is not None else None, kind)


def ssg_markdown(payload: Column) -> Column:
    return arrow_udf(_rendered, RESULT)(payload)
