"""The whole plan: pages (url, html) to pruned, query-aware Markdown with metadata and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.batches import bounded
from siftwell.functions.html import dom
from siftwell.functions.text import estimate_tokens, reduction, where_after
from siftwell.operators.bm25 import BUDGET, bm25_filter
from siftwell.operators.classify import is_static, render_type, ssg_payload
from siftwell.operators.extract import overflowing, with_nodes
from siftwell.operators.meta import meta
from siftwell.operators.serialize import serialize
from siftwell.operators.ssg import ssg_markdown

RESULT = [
    "url", "render_type", "markdown", "original_tokens", "refined_tokens", "reduction_ratio", "fetch_ms", "parse_ms", "bm25_confidence", "cached", "meta",
]
#: What plans read of a table of pages; the last two only where they are there.
PAGE = ("url", "html", "fetch_error", "fetch_ms")
TOO_NESTED = "Table rows that are never closed hold too much text: "
NO_CONTENT = "No extractable content; the page may require JavaScript rendering: "


def page_columns(pages: DataFrame) -> list[str]:
    return [c for c in PAGE if c in pages.columns]


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``dom``, parsed once per row (a barrier keeps the parse from being repeated)."""
    return bounded(pages).withColumn("dom", dom(F.col(html)))


def prune(pages: DataFrame, query: Column | str = "", *, budget: int = BUDGET, keep: tuple[str, ...] = ()) -> DataFrame:
    """Results of ``pages`` (url, html): the RESULT columns and ``error``, null where all went well.

    ``query`` is a string or a column; blank leaves ``bm25_confidence`` null.  A static page gives
    its rendered payload unless the query selects sections of its elements.  Null html counts as an
    empty page; where ``pages`` has ``fetch_error``, a page that failed to load has that error.
    ``keep`` names further columns to carry along, whatever their names but those of a result;
    others are not read.  ``fetch_ms`` is the pages' own, 0 without one; ``parse_ms`` the time that
    the parse took.
    """
    if taken := {*RESULT, "error"} & set(keep):
        raise ValueError(f"columns of a result cannot be kept: {sorted(taken)}")
    text = F.lit(query) if isinstance(query, str) else query
    failed = F.col("fetch_error").cast("string") if "fetch_error" in pages.columns else F.lit(None).cast("string")
    took = F.coalesce(F.col("fetch_ms").cast("double"), F.lit(0.0)) if "fetch_ms" in pages.columns else F.lit(0.0)
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    page = bounded(pages).select(kept.alias("kept"), failed.alias("failed"), took.alias("fetch_ms"), "url", F.coalesce("html", F.lit("")).alias("html"), F.coalesce(text, F.lit("")).alias("asked"))
    page = page.withColumn("payload", ssg_payload(F.col("html")))
    page = page.withColumns({"kind": render_type(F.col("html"), F.col("payload")), "original_tokens": estimate_tokens(F.col("html"))})
    # only static pages have a payload to render; the dom column replaces html from here on
    page = page.withColumn("ssg", ssg_markdown(F.when(is_static(F.col("payload")), F.col("payload")))).withColumn("dom", dom(F.col("html"))).drop("html", "payload")
    page = with_nodes(page).withColumn("filtered", F.when(F.col("asked") != "", bm25_filter(F.col("nodes"), F.col("asked"), budget)))
    confidence = F.col("filtered.confidence")
    static = F.col("ssg").isNotNull()
    markdown = F.when(static & ~F.coalesce(confidence > 0, F.lit(False)), F.col("ssg.markdown"))
    page = page.withColumn("markdown", F.coalesce(markdown, serialize(F.coalesce("filtered.nodes", "nodes"))))
    page = page.withColumn("refined_tokens", estimate_tokens(F.col("markdown")))
    # nodes have text or are table rows, a rendered payload has text, and the filter keeps two sections at
    # least: the Markdown is blank without any of them only, and errors do not need it
    empty = ~static & (F.size("nodes") == 0)
    nested = F.when(overflowing(F.col("dom.elements")), F.concat(F.lit(TOO_NESTED), F.coalesce("url", F.lit(""))))
    return page.select(
        *[F.col("kept")[c].alias(c) for c in keep],
        "url",
        F.when((F.col("kind") == "SSG") & ~static, "SSR").otherwise(F.col("kind")).alias("render_type"),
        "markdown",
        "original_tokens",
        "refined_tokens",
        reduction(F.col("original_tokens"), F.col("refined_tokens")).alias("reduction_ratio"),
        "fetch_ms",
        F.col("dom.ms").alias("parse_ms"),
        confidence.alias("bm25_confidence"),
        F.lit(False).alias("cached"),
        meta(F.col("dom.meta")).alias("meta"),
        F.coalesce("failed", nested, F.when(empty, F.concat(F.lit(NO_CONTENT), F.coalesce("url", F.lit(""))))).alias("error"),
    )


def checked(results: DataFrame, ignore_errors: bool = True) -> DataFrame:
    """Results without failed rows, or with the first failure raised."""
    if ignore_errors:
        return where_after(results, F.col("error").isNull()).drop("error")
    markdown = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("markdown"))
    return results.withColumn("markdown", markdown).drop("error")


def prune_requests(pages: DataFrame, requests: DataFrame, *, budget: int = BUDGET, ignore_errors: bool = True, key: str = "url") -> DataFrame:
    """A row for each of ``requests`` (url, query): each distinct pair is computed once and joined
    back; all but one row of a pair are marked as cached, and took no time.  Where several pages share
    a URL, ``key`` names a column of both tables, in place of the URL, that tells them apart."""
    keys = requests.select(F.col(f"`{key}`").alias("page"), F.coalesce("query", F.lit("")).alias("query"))
    counted = keys.groupBy("page", "query").agg(F.count("*").alias("count"))
    work = pages.select(*page_columns(pages), F.col(f"`{key}`").alias("page")).join(counted, "page")
    done = checked(prune(work, F.col("query"), budget=budget, keep=("query", "count")), ignore_errors)
    copies = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))))
    again = F.col("copy") > 1
    times = {c: F.when(again, 0.0).otherwise(F.col(c)) for c in ("fetch_ms", "parse_ms")}
    return copies.withColumns({"cached": again, **times}).drop("copy", "count")
