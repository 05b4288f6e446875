"""Where pages come from and where results go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.plans.prune import checked, page_columns, prune
from siftwell.sources.fetch import Policy, fetch_table
from siftwell.sources.storage import written

DOCUMENT_KEYS = ("source", "render_type", "original_tokens", "refined_tokens", "reduction_ratio", "bm25_confidence", "cached")


def url_list(spark: SparkSession, urls: Sequence[str]) -> DataFrame:
    """(ord, url) of a list, in its order, repeats kept."""
    return spark.createDataFrame(list(enumerate(urls)), "ord int, url string")


def load_one(pages: DataFrame, url: str, query: str = "") -> DataFrame:
    """The document of one URL; a failure is raised, also that there is no such page."""
    asked = pages.sparkSession.createDataFrame([(url,)], "url string")
    return load_batch(pages.where(F.col("url") == url), asked, query, ignore_errors=False)


def markdown_of(pages: DataFrame, url: str, query: str = "") -> DataFrame:
    """Only the Markdown of one URL, as a tool for agents wants it."""
    return load_one(pages, url, query).select(F.col("page_content").alias("markdown"))


def asked_for(urls: DataFrame, pages: DataFrame, ignore_errors: bool, key: str = "url") -> DataFrame:
    """``urls`` with html, fetch_error and fetch_ms of their pages; unless errors are ignored, one
    without a page stays with an error.  Other columns of ``pages`` are not read but ``key``, which both
    tables have and which tells pages of one URL apart."""
    own = {c: F.col("page")[c] for c in page_columns(pages) if c != "url"}
    known = pages.select(key, F.struct(*[c for c in own]).alias("page"))
    found = urls.join(known, key, "inner" if ignore_errors else "left")
    error = F.when(F.col("page").isNull(), F.concat(F.lit("No such page: "), "url")).otherwise(own.pop("fetch_error", F.lit(None)))
    return found.select(*urls.columns, *[x.alias(c) for c, x in own.items()], error.alias("fetch_error"))


def load_batch(pages: DataFrame, urls: DataFrame, query: str = "", *, ignore_errors: bool = True) -> DataFrame:
    """Documents of listed URLs, in no order; a URL listed twice comes twice.  One without a page,
    or whose page failed to load, is left out, or raised if errors are not ignored."""
    return documents(checked(prune(asked_for(urls.select("url"), pages, ignore_errors), query), ignore_errors))


def load_urls(urls: DataFrame, query: str = "", *, policy: Policy | None = None, ignore_errors: bool = True) -> DataFrame:
    """Documents of listed URLs from the network: each different URL is fetched once, politely by host,
    and comes as often as it is listed, under the URL that answered in the end.  Failures are left
    out, or raised if errors are not ignored."""
    got = written(fetch_table(urls, policy=policy), "fetched")
    listed = urls.select(F.col("url").alias("request_url")).join(got, "request_url")
    pages = listed.select(F.coalesce("url", "request_url").alias("url"), "html", "fetch_error", "fetch_ms")
    return documents(checked(prune(pages, query), ignore_errors))


def retrieve(pages: DataFrame, urls: DataFrame, query: str, *, query_as_bm25: bool = True, ignore_errors: bool = True, key: str = "url") -> DataFrame:
    """Documents of listed URLs (ord, url) with ``ord``, to be read in its order.  The query selects
    sections only if ``query_as_bm25``; all pages come back, there is no ranking across pages.  Where
    several pages share a URL, ``key`` names a column of both tables that tells them apart."""
    listed = urls.select(*dict.fromkeys(("ord", "url", key)))
    found = prune(asked_for(listed, pages, ignore_errors, key), query if query_as_bm25 else "", keep=("ord",))
    return documents(checked(found, ignore_errors), "ord").orderBy("ord")


def documents(results: DataFrame, *keep: str) -> DataFrame:
    """(page_content, metadata): metadata maps names to values as text and takes in ``meta``."""
    own = F.create_map(*[x for k in DOCUMENT_KEYS for x in (F.lit(k), F.col("url" if k == "source" else k).cast("string"))])
    known = F.map_filter(own, lambda k, v: v.isNotNull() | (k == "bm25_confidence"))
    clear = F.map_filter(known, lambda k, v: ~F.array_contains(F.map_keys(F.col("meta")), k))
    return results.select(*keep, F.col("markdown").alias("page_content"), F.map_concat(clear, "meta").alias("metadata"))


def to_json(results: DataFrame) -> DataFrame:
    """One JSON text per result with all its fields."""
    return results.select("url", F.to_json(F.struct(*results.columns), {"ignoreNullFields": "false"}).alias("json"))


def human(row: dict) -> str:
    """A result for people."""
    meta = row["meta"] or {}
    confidence = f"{row['bm25_confidence']:.2f}" if row["bm25_confidence"] else "—"  # also where nothing matched
    lines = [("URL", row["url"])]
    lines += [("Title", meta["title"])] if meta.get("title") else []
    lines += [
        ("Render type", row["render_type"]),
        ("Tokens", f"{row['original_tokens']:,} → {row['refined_tokens']:,}  ({row['reduction_ratio']:.1%} reduction)"),
        ("BM25 score", confidence),
        ("Cached", "Yes" if row["cached"] else "No"),
        ("Fetch", f"{row['fetch_ms']:.0f}ms  Parse: {row['parse_ms']:.0f}ms"),
    ]
    lines += [(k, v) for k, v in meta.items() if k != "title"]
    return "\n".join([*(f"{k:<13}: {v}" for k, v in lines), "─" * 60, row["markdown"]])


def human_text(results: DataFrame) -> DataFrame:
    """(url, text) of results for people, as ``human`` writes one; numbers rounded half up."""
    m = F.col("meta")
    count = lambda c: F.format_number(F.col(c), 0)
    shown = F.when(F.coalesce(F.col("bm25_confidence"), F.lit(0.0)) == 0, "—").otherwise(F.format_string("%.2f", "bm25_confidence"))
    percent = F.round(F.col("reduction_ratio") * 1000) / 10  # a hundredfold of 0.6375 falls below its half
    tokens = F.concat(count("original_tokens"), F.lit(" → "), count("refined_tokens"), F.lit("  ("), F.format_string("%.1f", percent), F.lit("% reduction)"))
    lines = [("URL", F.col("url")), ("Title", F.nullif(m["title"], F.lit(""))), ("Render type", F.col("render_type")), ("Tokens", tokens), ("BM25 score", shown)]
    lines += [("Cached", F.when(F.col("cached"), "Yes").otherwise("No")), ("Fetch", F.format_string("%.0fms  Parse: %.0fms", "fetch_ms", "parse_ms"))]
    named = [F.concat(F.lit(f"{k:<13}: "), v) for k, v in lines]
    others = F.transform(F.map_entries(F.map_filter("meta", lambda k, v: k != "title")), lambda e: F.concat(F.rpad(e["key"], F.greatest(F.length(e["key"]), F.lit(13)), F.lit(" ")), F.lit(": "), e["value"]))
    text = F.concat_ws("\n", *named, F.array_join(F.array_append(F.coalesce(others, F.array().cast("array<string>")), F.lit("─" * 60)), "\n"), F.col("markdown"))
    return results.select("url", text.alias("text"))


def matches_prefix(url: Column, prefixes: Sequence[str] | None) -> Column:
    """Whether a URL starts with any prefix; without prefixes every URL does."""
    if not prefixes:
        return F.lit(True)
    out = F.lit(False)
    for p in prefixes:
        out = out | url.startswith(p)
    return out
