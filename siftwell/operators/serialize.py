"""Nodes to Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import let, strip

MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "li": "- ", "blockquote": "> "}


def table_line(node: Column) -> Column:
    """A row as a table line, a header row with its rule below."""
    cells = F.when(F.size(node["cells"]) > 0, node["cells"]).otherwise(F.array(node["text"]))
    rule = F.array_join(F.transform(cells, lambda c: F.lit("---")), " | ")
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"), F.when(node["is_header"], F.concat(F.lit("\n| "), rule, F.lit(" |"))).otherwise(""))


def block(node: Column) -> Column:
    """A node's Markdown; empty for a blank text."""
    return let(strip(node["text"]), lambda text: _block(node, text))


def _block(node: Column, text: Column) -> Column:
    out = text
    for tag, mark in MARKS.items():
        out = F.when(node["tag"] == tag, F.concat(F.lit(mark), text)).otherwise(out)
    fenced = F.concat(F.lit("```"), F.coalesce(node["code_lang"], F.lit("")), F.lit("\n"), text, F.lit("\n```"))
    out = F.when(node["tag"].isin("pre", "code"), fenced).otherwise(out)
    return F.when(node["tag"] == "table_row", table_line(node)).when(text == "", "").otherwise(out)


def serialize(nodes: Column) -> Column:
    """Blocks joined by blank lines; neighbouring table rows by single line ends."""

    def join(parts: Column) -> Column:
        def lead(p: Column, i: Column) -> Column:
            run = p["row"] & F.coalesce(F.get(parts, i - 1)["row"], F.lit(False))
            return F.concat(F.when(i == 0, "").when(run, "\n").otherwise("\n\n"), p["md"])

        return F.array_join(F.transform(parts, lead), "")

    blocks = F.transform(nodes, lambda n: F.struct(block(n).alias("md"), (n["tag"] == "table_row").alias("row"), n["pos"].alias("pos")))
    return let(F.filter(blocks, lambda b: b["row"] | (b["md"] != "")), join)
