"""Request logs: single flight and a cache with time to live and bounded size, as folds of the log."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


TTL, MAX_SIZE = 300.0, 256


def single_flight(requests: DataFrame, *keys: str) -> DataFrame:
    """(keys, fetches, hits): concurrent requests of one key fetch once."""
    return requests.groupBy(*keys).agg(F.lit(1).alias("fetches"), (F.count("*") - 1).alias("hits"))


def ttl_hits(requests: DataFrame, key: str, at: Column, ttl: float = TTL, order: str = "event_id") -> DataFrame:
    """``requests`` reduced to (key, order, hit): a hit comes less than ``ttl`` seconds after the
    last miss of its key; hits do not prolong an entry.

    A key's log is one ordered stream, read row by row with one number of state, so a hot key costs
    time in one task but no memory."""
    if len({key, order, "hit"}) < 3:
        raise ValueError("key and order are two columns, neither of them named hit")
    seconds = at.cast("timestamp").cast("double")
    log = requests.select(F.col(f"`{key}`").alias("key"), F.col(f"`{order}`").alias("seq"), seconds.alias("t"))
    kinds = dict(log.dtypes)
    ordered = log.repartition("key").sortWithinPartitions("key", "t", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, until = None, float("-inf")
        for frame in frames:
            hits, keys = [], frame["key"]
            if keys.isna().any():  # nulls are one key
                keys = keys.astype(object).where(keys.notna(), None)
            for k, t in zip(keys, frame["t"]):
                if k != current:
                    current, until = k, float("-inf")
                hits.append(ttl > 0 and t < until)
                until = until if hits[-1] else t + ttl
            yield pd.DataFrame({key: frame["key"], order: frame["seq"], "hit": hits})

    return ordered.mapInPandas(run, f"`{key}` {kinds['key']}, `{order}` {kinds['seq']}, hit boolean")


def lru_cache(requests: DataFrame, key: str, at: Column, *, ttl: float = TTL, max_size: int = MAX_SIZE, shard: str | None = None, order: str = "event_id") -> DataFrame:
    """(shard, order, key, hit, size): a least-recently-used cache with time to live per ``shard``.

    A cache is sequential by nature: each shard is one cache and one ordered stream, read row by
    row with memory bounded by ``max_size``, and shards run in parallel.  Without ``shard`` the log
    is one cache, as in one process.  Expired entries go when an entry is stored; a repeated key
    that expired is stored anew."""
    part = F.col(shard).cast("string") if shard else F.lit("all")
    log = requests.select(part.alias("shard"), F.col(order).alias("seq"), F.col(key).cast("string").alias("key"), at.cast("timestamp").cast("double").alias("t"))
    ordered = log.repartition("shard").sortWithinPartitions("shard", "t", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, entries = None, OrderedDict()
        for frame in frames:
            hits, sizes = [], []
            for s, k, t in zip(frame["shard"], frame["key"], frame["t"]):
                if s != current:
                    current, entries = s, OrderedDict()
                hit = ttl > 0 and k in entries and t < entries[k]
                if hit:
                    entries.move_to_end(k)
                elif ttl > 0:
                    for dead in [x for x, until in entries.items() if t >= until]:
                        del entries[dead]
                    entries.pop(k, None)
                    while len(entries) >= max_size:
                        entries.popitem(last=False)
                    entries[k] = t + ttl
                hits.append(hit)
                sizes.append(len(entries))
            yield pd.DataFrame({"shard": frame["shard"], "seq": frame["seq"], "key": frame["key"], "hit": hits, "size": sizes})

    return ordered.mapInPandas(run, "shard string, seq long, key string, hit boolean, size long")


def cache_stats(stored: DataFrame, key: str, stored_at: Column, now: Column, ttl: float = TTL) -> DataFrame:
    """(total, alive, expired) of entries, one for each key at its last store."""
    last = stored.groupBy(key).agg(F.max(stored_at.cast("timestamp").cast("double")).alias("t"))
    alive = F.col("t") + ttl > now.cast("timestamp").cast("double")
    return last.agg(F.count("*").alias("total"), F.count_if(alive).alias("alive"), F.count_if(~alive).alias("expired"))


def entry_key(url: Column, query: Column) -> Column:
    """A cache entry's key."""
    return F.struct(url.alias("url"), F.coalesce(query, F.lit("")).alias("query"))


