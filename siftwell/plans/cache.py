"""A cache of results that outlives the job: a table of entries on shared storage.

``ResultCache.answer`` takes a batch of requests at a time: entries that are alive answer theirs, the
other (url, query) pairs are computed once each and stored, and the table is written anew as the next
version.  An entry lives ``ttl`` seconds from when it was stored, however often it is asked for; of more
than ``max_size`` entries those used last stay.  A version counts once Spark has marked it as whole, so
a job that fails or loses executors leaves the one before.  One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.operators.bm25 import BUDGET
from siftwell.operators.requests import MAX_SIZE, TTL
from siftwell.plans.prune import RESULT, checked, page_columns, prune
from siftwell.sources.sink import filesystem

RESULT_TYPES = (
    "url string, render_type string, markdown string, original_tokens int, refined_tokens int, reduction_ratio double, fetch_ms double, parse_ms double, "
    "bm25_confidence double, cached boolean, meta map<string, string>"
)
#: ``page`` tells pages apart: the URL, or a key of the caller's.
ENTRY = f"page string, query string, {RESULT_TYPES}, stored_at double, used_at double"
KEY = ["url", "query"]
ENTRY_KEY = ["page", "query"]
#: Parts that entries used at one time are counted in, so that no task ranks them all.
PARTS = 1024


def most_recent(entries: DataFrame, most: int, key: Sequence[str] = KEY) -> DataFrame:
    """``entries`` without those used longest ago, so that ``most`` are left; of those used at one
    time the ones with smaller hashes of their keys stay.

    Counts by time and part of the hashes tell which parts stay whole; only the one that does not is
    ranked row by row."""
    h = F.xxhash64(*key)
    parted = entries.withColumn("part", F.pmod(h, F.lit(PARTS)))
    counts = parted.groupBy("used_at", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("used_at"), "part").rowsBetween(Window.unboundedPreceding, -1))
    room = counts.select("used_at", "part", "n", (F.lit(most) - F.coalesce(before, F.lit(0))).alias("room")).where("room > 0")
    rows = parted.join(room, ["used_at", "part"])
    rank = F.row_number().over(Window.partitionBy("used_at", "part").orderBy(h, *key))
    cut = rows.where("n > room").withColumn("rank", rank).where("rank <= room").drop("rank")
    return rows.where("n <= room").unionByName(cut).select(*entries.columns)


class ResultCache:
    def __init__(self, spark: SparkSession, folder: str, ttl: float = TTL, max_size: int = MAX_SIZE, key: str = "url"):
        """``key`` names the column of pages and requests that tells pages apart, where several share a URL."""
        self.spark, self.folder, self.ttl, self.max_size, self.key = spark, folder.rstrip("/"), ttl, max_size, key

    def versions(self) -> list[int]:
        """Numbers of the whole versions, the last one first."""
        files, path = filesystem(self.folder)
        found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        numbers = [int(x.base_name[2:]) for x in found if x.type == fs.FileType.Directory and x.base_name.startswith("v=")]
        whole = lambda n: files.get_file_info(f"{path}/v={n}/entries/_SUCCESS").type == fs.FileType.File
        return sorted(filter(whole, numbers), reverse=True)

    def entries(self) -> DataFrame:
        """The stored entries, expired ones included."""
        last = next(iter(self.versions()), None)
        if last is None:
            return self.spark.createDataFrame([], ENTRY)
        found = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/v={last}/entries")
        return found.withColumn("page", F.coalesce("page", "url"))  # entries of older versions have none

    def alive(self, now: float) -> DataFrame:
        return self.entries().where((F.lit(self.ttl) > 0) & (F.col("stored_at") + self.ttl > now))

    def stats(self, now: float) -> DataFrame:
        """(total, alive, expired) of the stored entries."""
        lives = F.col("stored_at") + self.ttl > now
        return self.entries().agg(F.count("*").alias("total"), F.count_if(lives).alias("alive"), F.count_if(~lives).alias("expired"))

    def clear(self) -> None:
        files, path = filesystem(self.folder)
        if files.get_file_info(path).type != fs.FileType.NotFound:
            files.delete_dir(path)

    def answer(self, pages: DataFrame, requests: DataFrame, now: float, *, budget: int = BUDGET) -> DataFrame:
        """A result for each of ``requests`` (url, query) at time ``now`` (seconds), as from
        ``prune_requests``; those that an entry answered, or another request of the batch, are marked
        as cached and took no time.  Failed pages are left out and not stored.  Other columns of
        ``pages`` and ``requests`` are not read; a ``ttl`` of 0 or less stores nothing."""
        number = next(iter(self.versions()), 0) + 1
        at = f"{self.folder}/v={number}"
        page = F.col(f"`{self.key}`").cast("string").alias("page")
        asked = requests.select(page, F.coalesce("query", F.lit("")).alias("query")).groupBy(*ENTRY_KEY).agg(F.count("*").alias("times"))
        alive, clock = self.alive(now), F.lit(float(now))
        missing = pages.select(*page_columns(pages), page).join(asked.join(alive.select(*ENTRY_KEY), ENTRY_KEY, "left_anti").drop("times"), "page")
        fresh = checked(prune(missing, F.col("query"), budget=budget, keep=("page", "query"))).withColumns({"stored_at": clock, "used_at": clock})
        fresh.select(*self.spark.createDataFrame([], ENTRY).columns).write.mode("overwrite").parquet(f"{at}/fresh")
        fresh = self.spark.read.schema(ENTRY).parquet(f"{at}/fresh")
        hits = alive.join(asked.drop("times"), ENTRY_KEY, "left_semi").withColumn("used_at", clock)
        if self.ttl > 0:
            rest = alive.join(asked.drop("times"), ENTRY_KEY, "left_anti")
            most_recent(rest.unionByName(hits).unionByName(fresh), self.max_size, ENTRY_KEY).write.mode("overwrite").parquet(f"{at}/entries")
            self._drop_before(number - 1)
        known = fresh.withColumn("first", F.lit(1)).unionByName(hits.withColumn("first", F.lit(0)))
        copies = known.join(asked, ENTRY_KEY).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        again = F.col("copy") > F.col("first")
        times = {c: F.when(again, 0.0).otherwise(F.col(c)) for c in ("fetch_ms", "parse_ms")}
        return copies.withColumns({"cached": again, **times}).select("query", *RESULT)

    def _drop_before(self, number: int) -> None:
        """Versions before the last one that answers may still read."""
        files, path = filesystem(self.folder)
        for old in files.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            if old.base_name.startswith("v=") and int(old.base_name[2:]) < number:
                files.delete_dir(old.path)
