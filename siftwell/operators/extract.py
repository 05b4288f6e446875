"""Content nodes of a parsed page: semantic tags, else heading clusters, else text density.

Everything is row-local: higher-order functions over the ``elements`` array, no shuffle.  A node is
struct(pos, tag, text, depth, code_lang, cells, is_header); ``pos`` numbers them in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.html import CONTAINER_TAGS, CONTENT_TAGS
from siftwell.functions.text import let

ROW = "struct<first:int,last:int,is_header:boolean,bytes:bigint>"
ROWS = f"array<{ROW}>"
NODE = "struct<pos:int,tag:string,text:string,depth:int,code_lang:string,cells:array<string>,is_header:boolean>"
HEADINGS = ("h1", "h2", "h3", "h4", "h5")
BOUNDARIES, ANCHORS = ("h1", "h2", "h3", "h4"), ("h2", "h3", "h4")
# Openings of lines that only help to find one's way.
BOILERPLATE = (
    r"(?i)^(skip (to|navigation|main|content)|jump to (content|main|navigation)|go to (main content|content|navigation))"
)
BOILERPLATE_CHARS = 32  # more than any of them has
MIN_NODES, MIN_CHARS = 4, 200
MIN_CLUSTERS, MIN_CLUSTER_CHARS, MAX_LINKS, MIN_FLAT = 2, 400, 0.3, 3
MIN_CONTAINER_CHARS, DEPTH_STEP = 200, 0.04
#: A table whose rows' texts come to more, as rows never closed hold each other, is not held in one array:
#: ``node_rows`` makes its texts a row at a time.  In arrays of nodes it has no rows, and the page counts
#: as failed, since its Markdown could not be held.
MAX_TABLE_CHARS = 1 << 27
MAX_ROW_BYTES = (1 << 31) - 16  # of a string in Spark
ROW_TOO_LONG = "A table row has more text than a string can hold, in bytes: "


def _tag_in(element: Column, tags) -> Column:
    return element["tag"].isin(*sorted(tags))


def covered(nodes: Column) -> Column:
    """Whether nodes are enough to stand for a page: 4 nodes and 200 characters."""
    chars = F.aggregate(nodes, F.lit(0).cast("long"), lambda a, n: a + F.length(n["text"]))
    return F.coalesce((F.size(nodes) >= MIN_NODES) & (chars >= MIN_CHARS), F.lit(False))


def numbered(nodes: Column) -> Column:
    return F.transform(nodes, lambda n, i: n.withField("pos", i))


def _node(e: Column, root: Column, tag: Column, text: Column, cells: Column, header: Column) -> Column:
    return F.struct(
        F.lit(0).alias("pos"), tag.alias("tag"), text.alias("text"), (e["depth"] - root["depth"]).alias("depth"), e["code_lang"].alias("code_lang"),
        cells.alias("cells"), header.alias("is_header"),
    )


def _range(values: Column, span: Column) -> Column:
    return F.slice(values, span["first"] + 1, span["last"] - span["first"])


def _row_cells(tables: Column, r: Column) -> Column:
    return F.transform(_range(tables["cells"], r), lambda c: F.array_join(_range(tables["strings"], c), " "))


def _table_nodes(e: Column, root: Column, tables: Column) -> Column:
    def row(r: Column) -> Column:
        return let(_row_cells(tables, r), lambda texts: _node(e, root, F.lit("table_row"), F.array_join(texts, " | "), texts, r["is_header"]))

    rows = F.when(e["rows"]["chars"] <= MAX_TABLE_CHARS, _range(tables["rows"], e["rows"]))
    return F.transform(F.coalesce(rows, F.array().cast(ROWS)), row)


def _open_table_nodes(e: Column, root: Column, tables: Column) -> Column:
    """As ``_table_nodes``, with ``row``: of a table that is not held as a whole, the row that cells and
    text are to be made from; else null."""

    def row(r: Column) -> Column:
        return _node(e, root, F.lit("table_row"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), r["is_header"]).withField("row", r)

    rows = F.when(e["rows"]["chars"] > MAX_TABLE_CHARS, F.transform(_range(tables["rows"], e["rows"]), row))
    return F.coalesce(rows, F.transform(_table_nodes(e, root, tables), _whole))


def _whole(node: Column) -> Column:
    return node.withField("row", F.lit(None).cast(ROW))


def overflowing(elements: Column) -> Column:
    """Whether a page has a table whose rows cannot be held."""
    return F.exists(elements, lambda e: F.coalesce(e["rows"]["chars"] > MAX_TABLE_CHARS, F.lit(False)))


def _firsts(nodes: Column) -> Column:
    """Nodes without those whose text an earlier one has; table rows all stay.  Equal texts come
    together in a sort, so that a page of n nodes takes n log n steps."""

    def kept(n: Column) -> Column:
        places = F.transform(n, lambda x, i: F.struct((x["tag"] != "table_row").alias("text"), F.when(x["tag"] != "table_row", x["text"]).alias("t"), i.alias("i")))

        def first_places(p: Column) -> Column:
            fresh = lambda x, k: ~x["text"] | (k == 0) | ~x["t"].eqNullSafe(F.get(p, k - 1)["t"])
            return F.sort_array(F.transform(F.filter(p, fresh), lambda x: x["i"]))

        return F.transform(let(F.sort_array(places), first_places), lambda i: F.get(n, i))

    return let(nodes, kept)


def walk(elements: Column, root: Column, open_tables: bool = False) -> Column:
    """Content nodes below ``root`` (an element): noise pruned, content tags and tables taken whole,
    short texts and boilerplate dropped, of equal texts the first kept; with ``open_tables`` as
    ``_open_table_nodes`` has them."""
    rows, whole = (_open_table_nodes, _whole) if open_tables else (_table_nodes, lambda n: n)

    def from_root(x: Column) -> Column:
        r = x["root"]

        def reached(e: Column) -> Column:
            return (e["pre"] >= r["pre"]) & (e["pre"] <= r["end"]) & (e["stop1"] < r["pre"]) & _tag_in(e, CONTENT_TAGS | {"table"})

        def nodes(e: Column) -> Column:
            no_cells = F.lit(None).cast("array<string>")
            one = F.array(whole(_node(e, r, e["tag"], e["text"], no_cells, F.lit(False))))
            return F.when(e["tag"] == "table", rows(e, r, x["tables"])).otherwise(one)

        def wanted(n: Column) -> Column:
            long = F.length(n["text"]) >= F.when(n["tag"].isin(*HEADINGS), 3).otherwise(10)
            return (n["tag"] == "table_row") | (long & ~F.substring(n["text"], 1, BOILERPLATE_CHARS).rlike(BOILERPLATE))

        return numbered(_firsts(F.filter(F.flatten(F.transform(F.filter(elements, reached), nodes)), wanted)))

    both = F.struct(root.alias("root"), F.get(elements, F.lit(0))["tables"].alias("tables"))
    return F.when(root.isNotNull(), let(both, from_root))


def first_of(elements: Column, tag: str) -> Column:
    return F.get(F.filter(elements, lambda e: e["tag"] == tag), F.lit(0))


def body_of(elements: Column) -> Column:
    return F.coalesce(first_of(elements, "body"), F.get(elements, F.lit(0)))


def l1_nodes(elements: Column) -> Column:
    """Nodes of the body, or of the whole document without one."""
    return walk(elements, body_of(elements))


def node_rows(pages: DataFrame, *keep: str, elements: str = "dom.elements") -> DataFrame:
    """``keep`` and a row for each node of ``l1_nodes``, whatever the texts of a page's tables come to: of
    tables that an array does not hold, a task holds one row's text at a time.  A single row whose text
    no string can hold raises."""
    e = F.col(elements)
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    tables = F.when(overflowing(e), F.get(e, F.lit(0))["tables"])
    nodes = pages.select(kept.alias("kept"), tables.alias("tables"), walk(e, body_of(e), open_tables=True).alias("nodes"))
    # the outer form, as Spark would parse every page once more to leave out those without nodes
    nodes = nodes.select("kept", "tables", F.inline_outer("nodes")).where("pos IS NOT NULL")
    row = F.col("row")
    fits = F.when(row["bytes"] > MAX_ROW_BYTES, F.raise_error(F.concat(F.lit(ROW_TOO_LONG), row["bytes"])).cast("array<string>"))
    cells = F.when(row.isNull(), F.col("cells")).otherwise(F.coalesce(fits, _row_cells(F.col("tables"), row)))
    text = F.when(row.isNull(), F.col("text")).otherwise(F.array_join(F.coalesce(fits, _row_cells(F.col("tables"), row)), " | "))
    made = nodes.select("kept", "pos", "tag", text.alias("text"), "depth", "code_lang", cells.alias("cells"), "is_header")
    return made.select(*[F.col("kept")[c].alias(c) for c in keep], *made.columns[1:])


def flat_blocks(elements: Column) -> Column:
    """Content elements of the main container with link lengths; noise pruned on every tag."""
    by_role = F.get(F.filter(elements, lambda e: e["role"] == "main"), F.lit(0))
    root = F.coalesce(first_of(elements, "main"), first_of(elements, "article"), by_role, F.get(elements, F.lit(0)))

    def blocks(r: Column) -> Column:
        def reached(e: Column) -> Column:
            inside = (e["pre"] >= r["pre"]) & (e["pre"] <= r["end"]) & (e["stop2"] < r["pre"])
            long = F.length(e["text"]) >= F.when(_tag_in(e, HEADINGS), 2).otherwise(10)
            return inside & _tag_in(e, CONTENT_TAGS) & ~e["noise"] & long

        def block(e: Column) -> Column:
            bare = e.withField("code_lang", F.lit(None).cast("string"))
            node = _node(bare, r, e["tag"], e["text"], F.lit(None).cast("array<string>"), F.lit(False))
            return F.struct(node.alias("node"), e["link_len"].alias("link_len"))

        return F.transform(F.filter(elements, reached), block)

    return let(root, blocks)


def clusters(blocks: Column) -> Column:
    """Blocks cut at h1-h4: struct(tag of the heading or null, text, link, nodes)."""

    def cut(b: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(b) - 1), lambda i: (i == 0) | F.get(b, i)["node"]["tag"].isin(*BOUNDARIES))

        def cluster(starts: Column) -> Column:
            def one(s: Column, k: Column) -> Column:
                own = F.slice(b, s + 1, F.coalesce(F.get(starts, k + 1), F.size(b)) - s)

                def sums(c: Column) -> Column:
                    tag = F.get(c, F.lit(0))["node"]["tag"]
                    zero = F.lit(0).cast("long")
                    return F.struct(
                        F.when(tag.isin(*BOUNDARIES), tag).alias("tag"),
                        F.aggregate(c, zero, lambda a, x: a + F.length(x["node"]["text"])).alias("text"),
                        F.aggregate(c, zero, lambda a, x: a + x["link_len"]).alias("link"),
                        F.transform(c, lambda x: x["node"]).alias("nodes"),
                    )

                return let(own, sums)

            return F.transform(starts, one)

        return let(heads, cluster)

    empty = F.array().cast(f"array<struct<tag:string,text:bigint,link:bigint,nodes:array<{NODE}>>>")
    return F.when(F.size(blocks) > 0, let(blocks, cut)).otherwise(empty)


def l2_nodes(elements: Column) -> Column:
    """Nodes of heading clusters; null unless two h2-h4 clusters hold 400 characters on average and
    three nodes stay once clusters that are mostly links are dropped."""

    def gate(c: Column) -> Column:
        own = F.filter(c, lambda x: F.coalesce(x["tag"].isin(*ANCHORS), F.lit(False)))
        chars = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["text"])
        enough = (F.size(own) >= MIN_CLUSTERS) & (F.try_divide(chars, F.size(own)) >= MIN_CLUSTER_CHARS)
        good = F.filter(c, lambda x: (x["text"] > 0) & (F.try_divide(x["link"], x["text"]) < MAX_LINKS))
        flat = F.flatten(F.transform(good, lambda x: x["nodes"]))
        return F.when(enough & (F.size(flat) >= MIN_FLAT), numbered(flat))

    return let(clusters(flat_blocks(elements)), gate)


def density_score(e: Column) -> Column:
    """Text per weighted tag, less for links and for depth."""
    links = F.try_divide(e["link_len"], e["text_len"])
    return e["text_len"] / F.greatest(e["weight"], F.lit(1.0)) * (1 - links) * F.greatest(F.lit(0.0), 1 - e["depth"] * DEPTH_STEP)


def best_container(elements: Column) -> Column:
    """struct(score, order, element) of the densest container, the first of equals; null if none."""
    fit = F.filter(elements, lambda e: _tag_in(e, CONTAINER_TAGS) & ~e["noise"] & (e["text_len"] >= MIN_CONTAINER_CHARS))
    scored = F.transform(fit, lambda e: F.struct(density_score(e).alias("score"), (-e["pre"]).alias("order"), e["end"].alias("end"), e["depth"].alias("depth")))
    best = F.array_max(scored)
    return F.when(best["score"] > -1.0, best)


def l3_nodes(elements: Column) -> Column:
    """Nodes below the densest container; empty without one."""
    root = let(best_container(elements), lambda b: F.when(b.isNotNull(), F.struct((-b["order"]).alias("pre"), b["end"].alias("end"), b["depth"].alias("depth"))))
    return F.coalesce(walk(elements, root), F.array().cast(f"array<{NODE}>"))


def cascade(l1: Column, l2: Column, l3: Column, l1_covers: Column, l2_covers: Column) -> Column:
    """The first layer that covers the page, with the density layer unless it is empty."""
    return F.when(l1_covers, l1).when(l2_covers, l2).when(F.size(l3) > 0, l3).when(F.size(l1) > 0, l1).otherwise(F.coalesce(l2, F.array().cast(f"array<{NODE}>")))


def with_nodes(pages: DataFrame, elements: str = "dom.elements") -> DataFrame:
    """``pages`` with l1, l2, l3 and ``nodes``; l2 and l3 are null where a layer before them covers
    the page, and are not computed there."""
    e = F.col(elements)
    first, second = F.col("l1_covers"), F.col("l2_covers")
    layers = pages.withColumn("l1", l1_nodes(e)).withColumn("l1_covers", covered(F.col("l1")))
    layers = layers.withColumn("l2", F.when(~first, l2_nodes(e))).withColumn("l2_covers", covered(F.col("l2")))
    layers = layers.withColumn("l3", F.when(~first & ~second, l3_nodes(e)))
    return layers.withColumn("nodes", cascade(F.col("l1"), F.col("l2"), F.col("l3"), first, second)).drop("l1_covers", "l2_covers")
