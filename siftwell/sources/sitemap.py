"""Sitemaps: URL sets and nested indexes, as tables of (url, xml).

Expansion is the transitive closure of the indexes.  The XML is parsed once, into a table of edges
on shared storage with the indexes' apart from the URL sets'.  Round by round the sitemaps reached
last are joined with the indexes' edges, which are few beside the pages, and only what is new goes
on; each round is a table of its own, so plans do not grow, and the driver sees one row of counts.
The sets' edges, which are as many as the pages, are read once, in one join with all that was reached.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import strip
from siftwell.sources.fetch import Policy, fetch_table
from siftwell.sources.pages import load_batch, load_urls, matches_prefix
from siftwell.sources.storage import written


def _locations(xml, kind: str):
    found = F.xpath(xml, F.lit("/*/url/loc/text()" if kind == "urlset" else "/sitemapindex/sitemap/loc/text()"))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def parse(sitemaps: DataFrame) -> DataFrame:
    """(url, is_index, urls) of ``sitemaps`` (url, xml): an index's sitemaps, or the locations below
    any other root; malformed XML raises."""
    is_index = F.xpath_boolean("xml", F.lit("boolean(/sitemapindex)"))
    found = F.when(is_index, _locations(F.col("xml"), "sitemapindex")).otherwise(_locations(F.col("xml"), "urlset"))
    return sitemaps.select("url", is_index.alias("is_index"), found.alias("urls"))


def edges(sitemaps: DataFrame) -> DataFrame:
    """(parent, place, child, is_index) of every location of every sitemap, on shared storage."""
    rows = parse(sitemaps).select(F.col("url").alias("parent"), F.posexplode("urls").alias("place", "child"), "is_index")
    return written(rows, "sitemap-edges", ["is_index"])


def reached(indexes: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """(ord, at) of every sitemap below ``root``, it included, as often as indexes lead there; ``ord``
    are the places on the way.  ``indexes`` (parent, place, child) must be materialised."""
    spark = indexes.sparkSession
    levels = [spark.createDataFrame([([0], root, [root])], "ord array<int>, at string, path array<string>")]
    while max_depth is None or len(levels) < max_depth:
        step = levels[-1].join(indexes, F.col("at") == F.col("parent"))
        level = step.select(F.array_append("ord", F.col("place")).alias("ord"), F.col("child").alias("at"), F.array_append("path", F.col("child")).alias("path"), F.array_contains("path", F.col("child")).alias("again"))
        level = written(level, "sitemap-level")
        found = level.agg(F.count("*").alias("rows"), F.min(F.when(F.col("again"), F.col("at"))).alias("again")).first()
        if not found.rows:
            break
        if max_depth is None and found.again is not None:
            raise ValueError(f"sitemap index below itself: {found.again}")
        levels.append(level.drop("again"))
    return reduce(DataFrame.unionAll, levels).select("ord", "at")


def expand(sitemaps: DataFrame, root: str, max_depth: int | None = None) -> DataFrame:
    """(ord, url) of all pages under a sitemap, child after child, repeats kept; a child that is not
    in the table adds nothing, a sitemap listed twice in the table counts twice.  An index below
    itself raises, unless ``max_depth`` bounds the levels.  Columns but url and xml are not read."""
    known = edges(sitemaps)
    found = reached(known.where("is_index").drop("is_index"), root, max_depth)
    pages = found.join(known.where("NOT is_index"), F.col("at") == F.col("parent"))
    return pages.select(F.array_append("ord", F.col("place")).alias("ord"), F.col("child").alias("url"))


def wanted(urls: DataFrame, prefixes: Sequence[str] | None) -> DataFrame:
    return urls.where((F.col("url") != "") & matches_prefix(F.col("url"), prefixes))


def fetch_sitemaps(spark: SparkSession, root: str, policy: Policy | None = None) -> DataFrame:
    """(url, xml) of the sitemap at ``root`` and of all below it, each asked for once however many
    indexes list it; one that cannot be had is left out.  A level of indexes is one fetch and one
    anti-join with all that was asked for, and nothing of it comes to the driver."""
    asked = [spark.createDataFrame([(root,)], "url string")]
    found = []
    while True:
        got = fetch_table(asked[-1], policy=policy).where("fetch_error IS NULL")
        found.append(written(got.select(F.col("request_url").alias("url"), F.col("html").alias("xml")), "sitemaps"))
        below = parse(found[-1]).where("is_index").select(F.explode("urls").alias("url")).distinct()
        level = written(below.join(reduce(DataFrame.unionAll, asked), "url", "left_anti"), "sitemap-urls")
        if level.isEmpty():
            return reduce(DataFrame.unionAll, found)
        asked.append(level)


def load_site(spark: SparkSession, root: str, query: str = "", *, prefixes: Sequence[str] | None = None, policy: Policy | None = None, ignore_errors: bool = True) -> DataFrame:
    """Documents of the pages of a whole site, from the network: its sitemaps, then the pages under
    them whose URLs start with one of ``prefixes``."""
    urls = wanted(expand(fetch_sitemaps(spark, root, policy), root), prefixes)
    return load_urls(written(urls.select("url"), "site-urls"), query, policy=policy, ignore_errors=ignore_errors)


def load_sitemap(pages: DataFrame, sitemaps: DataFrame, root: str, query: str = "", *, prefixes: Sequence[str] | None = None, ignore_errors: bool = True) -> DataFrame:
    """Documents of the pages under a sitemap whose URLs start with one of ``prefixes``."""
    urls = wanted(expand(sitemaps, root), prefixes)
    return load_batch(pages, urls, query, ignore_errors=ignore_errors)
