"""Pages and requests as streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators.requests import TTL
from siftwell.plans.cache import ResultCache
from siftwell.plans.prune import checked, prune


def page_stream(spark: SparkSession, folder: str, schema: str = "page_id long, url string, html string", files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of pages in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def prune_stream(pages: DataFrame, query: str = "") -> DataFrame:
    """Pruned pages of a stream; row-local, so any output mode and sink will do."""
    return checked(prune(pages, query))


def request_windows(requests: DataFrame, at: str = "ts", lateness: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(start, key, requests, fetches) in tumbling windows of event time with late rows dropped."""
    timed = requests.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", lateness)
    counted = timed.groupBy(F.window("at", width).alias("w"), "key").agg(F.count("*").alias("requests"))
    return counted.select(F.col("w.start").alias("start"), "key", "requests", F.lit(1).alias("fetches"))


def answer_stream(requests: DataFrame, pages: DataFrame, cache: ResultCache, write: Callable[[DataFrame, int], None], clock: Callable[[], float] = time.time):
    """A writer, not started yet, of a stream of (url, query): each batch is answered from the cache
    and what it lacks computed once and stored; ``write`` takes the answers and the batch's number."""
    return requests.writeStream.foreachBatch(lambda batch, number: write(cache.answer(pages, batch, clock()), number))


def cached_stream(requests: DataFrame, key: str = "key", ttl: float = TTL) -> DataFrame:
    """(key, t, hit) for a stream of (key, t in seconds): keyed state with time to live.

    Within a batch a key's rows are taken in order of time; its state is the time its entry ends."""

    def update(own, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        until = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(frames)).sort_values("t", kind="stable")
        hits = []
        for t in rows["t"]:
            hits.append(ttl > 0 and t < until)
            until = until if hits[-1] else t + ttl
        state.update((until,))
        yield pd.DataFrame({"key": rows[key].astype(str), "t": rows["t"], "hit": hits})

    return requests.groupBy(key).applyInPandasWithState(update, "key string, t double, hit boolean", "until double", "append", "NoTimeout")
