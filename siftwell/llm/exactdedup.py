"""Exact duplicates by digests, with heavy hitters apart, in DataFrame expressions only.

Texts are equal when they are identical without their white space.  Each row becomes a digest, the
length of its text and its number in one pass over the texts; that table is some fifty bytes a row,
is kept on shared storage, and all that follows reads it.

Misra-Gries summaries (Spark's ``freqItems``: the form of Karp, Schenker and Papadimitriou) find
every digest that holds more than a given share of the rows, in each task first, and merge; 1 / share
counters are a state's fixed size.  One more pass counts the candidates exactly, drops those below
the share and finds the row of each that stays.  These verified winners, at most 1 / share rows, are
broadcast: rows of heavy digests get their result, or are removed, where they are read.  The other
digests, none of which holds more than the share, are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.storage import written

#: The characters that do not count.
SPACES = " \t\n\v\f\r"
#: A digest with more than one in so many rows is heavy; so many rows are broadcast at most.
HEAVY = 512


def normalised(text: Column) -> Column:
    """``text`` without white space; null is empty."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def digests(docs: DataFrame, *others: Column) -> DataFrame:
    """(doc_id, digest, points) of every row of ``docs`` (doc_id, text), and the ``others``: the SHA-256
    of the normalised text and the code points of the original one."""
    digest = F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest")
    return docs.select("doc_id", digest, F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), *others)


def marked(docs: DataFrame) -> DataFrame:
    """``digests`` with a number that tells rows apart, on shared storage."""
    return written(digests(docs, F.monotonically_increasing_id().alias("number")), "digests")


def _best() -> Column:
    """The row that stays: most code points, smallest doc_id, null last, then the first one read."""
    return F.min(F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "number"))


def _grouped(marks: DataFrame) -> DataFrame:
    """(digest, group_size, best) of rows of digests; pre-aggregated before the shuffle."""
    return marks.groupBy("digest").agg(F.count("*").alias("group_size"), _best().alias("best"))


def heavy_hitters(marks: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(digest, group_size, best) of exactly the digests with more than one in ``heavy`` rows of
    ``marks``, fewer than ``heavy`` rows whatever the input.  ``marks`` must be materialised."""
    short = F.xxhash64("digest").alias("short")
    total, found = marks.count(), marks.select(short).freqItems(["short"], 1 / heavy).first()
    # 64 bits may be shared by chance: whole digests are counted
    counts = _grouped(marks.where(short.isin(found.short_freqItems)))
    return counts.where(F.col("group_size") * heavy > total)


def duplicate_groups(docs: DataFrame, *, heavy: int = HEAVY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts that with the most code points stays, then that with the smallest
    doc_id, null last; of rows that repeat both, exactly one is ``kept``.  Null text counts as
    empty, blank texts are all equal.  Other columns are not read; an empty table gives none.
    """
    marks = marked(docs)
    winners = F.broadcast(written(heavy_hitters(marks, heavy), "heavy"))
    light = marks.join(winners, "digest", "left_anti")
    judged = marks.join(winners, "digest").unionByName(light.join(_grouped(light), "digest"))
    return judged.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("number") == F.col("best.number")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, *, heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns whatever their names: one for each
    text, chosen as in ``duplicate_groups``; of rows that repeat text length and doc_id any one.

    Copies of heavy texts go before the shuffle, so that only one row of each is sent."""
    winners = F.broadcast(written(heavy_hitters(marked(docs), heavy), "heavy").select(F.col("digest").alias("known"), "best"))
    rows = digests(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    first = (F.col("points") == -F.col("best.less")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    left = rows.join(winners, F.col("digest") == F.col("known"), "left").where(F.col("known").isNull() | first)
    order = F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id")
    return left.groupBy("digest").agg(F.min_by("row", order).alias("row")).select("row.*")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP11_SQL = r"""
WITH texts AS (SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest FROM documents),
groups AS (SELECT *, first_value(doc_id) OVER (PARTITION BY digest ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY digest) AS group_size FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, digest AS text_sha256 FROM groups
"""
