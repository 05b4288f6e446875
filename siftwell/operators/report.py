"""Reports over results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import where_after


def report_rows(results: DataFrame) -> DataFrame:
    """Results with ``mode``: BM25 if the query selected sections, else full."""
    return results.withColumn("mode", F.when(F.coalesce(F.col("bm25_confidence") > 0, F.lit(False)), "BM25").otherwise("full"))


def averages(results: DataFrame) -> DataFrame:
    """One row: pages, token means (whole numbers), reduction as a ratio of sums, mean timings."""
    original, refined = F.sum("original_tokens"), F.sum("refined_tokens")
    return results.agg(
        F.count("*").alias("pages"),
        F.floor(F.try_divide(original, F.count("*"))).cast("long").alias("avg_original"),
        F.floor(F.try_divide(refined, F.count("*"))).cast("long").alias("avg_refined"),
        (1 - refined / F.greatest(original, F.lit(1))).alias("reduction"),
        F.avg("fetch_ms").alias("avg_fetch_ms"),
        F.avg("parse_ms").alias("avg_parse_ms"),
    )


def errors(results: DataFrame) -> DataFrame:
    """(url, error) of failed pages."""
    return where_after(results, F.col("error").isNotNull()).select("url", "error")


def published_since(documents: DataFrame, day: str) -> DataFrame:
    """Documents whose published_time is ``day`` or later, compared as text; a missing one is not."""
    return documents.where(F.coalesce(F.element_at("metadata", F.lit("published_time")), F.lit("")) >= day)


def confident(documents: DataFrame, least: float) -> DataFrame:
    """Documents whose section filter had a confidence above ``least``; none counts as 0."""
    return documents.where(F.coalesce(F.element_at("metadata", F.lit("bm25_confidence")).cast("double"), F.lit(0.0)) > least)


def cached_count(documents: DataFrame) -> DataFrame:
    """How many documents came from the cache."""
    return documents.agg(F.count_if(F.element_at("metadata", F.lit("cached")) == "true").alias("cached"))
