"""SimHash fingerprints, exact Hamming links through vantage-point trees, and their components.

Fingerprinting runs per row in Arrow batches.  Links are sought between *distinct* fingerprints
only, so groups of exact copies cost one row.

Search.  Two fingerprints within ``radius`` bits differ by at most ``radius // 2`` bits in one of
their 32-bit halves, and the Hamming distance on a half is a metric too.  So each half gets its own
vantage-point forest, searched with the small radius ``t = radius // 2``, for which triangle bounds
prune far better than on all 64 bits.  A node holds a vantage point v and a threshold r: x goes
inside when d(x, v) <= r.  A pair split by the node has d(inside) > r - t, so only such inside
fingerprints also visit the outer shard (and an outer shard's guests visit inner ones only within
r + t).  Every pair thus meets in the home shard of one of the two, and is then tested on all 64
bits.  The top of the forest is built from a bounded sample of fingerprints and broadcast; any
sample gives the same links, it only affects balance.  Each shard then grows its own tree.  Shards
above ``block_rows`` are split into blocks of homes and of guests, which bounds a task's memory.

A shard returns a spanning forest of its links instead of all pairs.  The forests are merged by
alternating large-star and small-star rounds on Spark tables, each cut on shared storage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm import shingles
from siftwell.llm.arrowtext import bounded, slices, utf8_values
from siftwell.llm.shingles import merged
from siftwell.llm.storage import cut, scratch, written

HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
WHOLE = np.uint64(0xFFFFFFFFFFFFFFFF)
LEAF = 96
CHUNK = 1 << 16


# -- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        grams: list[bytes] = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    counts = np.zeros(64, np.int64)
    for start in range(0, len(grams), CHUNK):
        digests = b"".join(map(xxhash.xxh64_digest, grams[start : start + CHUNK], repeat(seed)))
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row, fp being the fingerprint as a signed long; a column ``mark`` of
    longs, if there is one, comes along."""
    extra = ["mark"] if "mark" in docs.columns else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width, seed) for t in utf8_values(batch.column("text"))]
            values = np.array(found, np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), *(batch.column(c) for c in extra), pa.array(values)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *extra, "fp"])

    return bounded(docs.select("doc_id", *extra, "text")).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", *extra, "fp"]))


# -- vantage-point trees --------------------------------------------------------------------------


def distance(a: np.ndarray, b, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask)


def choose_split(homes: np.ndarray, mask: np.uint64, t: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a threshold that part ``homes`` with few of them within ``t`` of the
    threshold, as seen on some of them; None if no candidate leaves a tenth on each side."""
    some = homes[:: max(1, len(homes) // 2048)]
    n, best, best_cost = len(some), None, np.inf
    for vantage in homes[np.linspace(0, len(homes) - 1, min(8, len(homes))).astype(int)]:
        inside = np.cumsum(np.bincount(distance(some, vantage, mask), minlength=66))
        small = np.minimum(inside, n - inside)
        near = np.append(inside[t:], np.full(t, n)) - np.concatenate([np.zeros(t, np.int64), inside[: len(inside) - t]])
        cost = np.where(small * 5 >= n, near / np.maximum(small, 1), np.where(small * 10 >= n, 100 + near / np.maximum(small, 1), np.inf))
        r = int(cost.argmin())
        if cost[r] < best_cost:
            best, best_cost = (vantage, r), cost[r]
    return best


def build_top(sample: np.ndarray, mask: np.uint64, t: int, leaves: int) -> list:
    """A tree over ``sample`` with about ``leaves`` leaves: nested [vantage, r, inner, outer] or [shard]."""
    number = iter(range(1 << 40))

    def grow(rows: np.ndarray, wanted: int) -> list:
        split = choose_split(rows, mask, t) if wanted > 1 and len(rows) > 1 else None
        if split is None:
            return [next(number)]
        vantage, r = split
        inside = distance(rows, vantage, mask) <= r
        share = round(wanted * float(inside.mean()))
        return [vantage, r, grow(rows[inside], max(1, share)), grow(rows[~inside], max(1, wanted - share))]

    return grow(sample, leaves)


def route(tree: list, fps: np.ndarray, mask: np.uint64, t: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, fingerprints, guest) for every shard that ``fps`` live in or visit."""
    stack = [(tree, fps, fps[:0])]
    while stack:
        node, homes, guests = stack.pop()
        if len(node) == 1:
            for rows, guest in ((homes, False), (guests, True)):
                if len(rows):
                    yield node[0], rows, guest
            continue
        vantage, r, inner, outer = node
        dh, dg = distance(homes, vantage, mask), distance(guests, vantage, mask)
        inside = dh <= r
        stack.append((inner, homes[inside], guests[dg <= r + t]))
        stack.append((outer, homes[~inside], np.concatenate([homes[inside & (dh > r - t)], guests[dg > r - t]])))


def close_pairs(homes: np.ndarray, guests: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join the same fingerprints as all pairs within ``radius`` do: (left, right)."""
    for i in range(0, len(homes), 256):
        part = homes[i : i + 256]
        for rows in (homes[i:], guests):
            for k in range(0, len(rows), 4096):
                some = rows[k : k + 4096]
                match = distance(some[:, None], part[None, :], WHOLE) <= radius
                if not match.any():
                    continue
                first = match.argmax(axis=1)
                at, home = np.nonzero(match)
                pairs = np.unique(first[at] * len(part) + home)
                yield part[pairs // len(part)], part[pairs % len(part)]
                some_hit = match.any(axis=1)
                yield some[some_hit], part[first[some_hit]]


def search(homes: np.ndarray, guests: np.ndarray, half: np.uint64, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among homes, and between homes and guests, by a tree grown on the homes."""
    stack = [(homes, guests, half, radius // 2)]
    while stack:
        homes, guests, mask, t = stack.pop()
        if len(homes) <= LEAF:
            yield from close_pairs(homes, guests, radius)
            continue
        split = choose_split(homes, mask, t)
        if split is None:
            if mask != WHOLE:
                stack.append((homes, guests, WHOLE, radius))
            else:
                yield from close_pairs(homes, guests, radius)
            continue
        vantage, r = split
        dh, dg = distance(homes, vantage, mask), distance(guests, vantage, mask)
        inside = dh <= r
        stack.append((homes[inside], guests[dg <= r + t], mask, t))
        stack.append((homes[~inside], np.concatenate([homes[inside & (dh > r - t)], guests[dg > r - t]]), mask, t))


# -- distributed search ---------------------------------------------------------------------------

def hash_share(fps: DataFrame, total: int, bound: int) -> DataFrame:
    """(fp, h) of the share of the hashes that holds about 1.25 * ``bound`` of ``total`` different
    fingerprints, or all: what every partition together sends for a sample of ``bound``."""
    h = F.xxhash64("fp")
    share = min(1 << 24, -(-((bound * 5) << 24) // (4 * max(total, 1))))
    return fps.select("fp", h.alias("h")).where(F.shiftrightunsigned(h, 40) < share)


ROUTED = "forest int, shard long, home_block int, guest_block int, guest boolean, fp long"


def fingerprint_links(
    fps: DataFrame,
    radius: int = 3,
    *,
    shard_rows: int = 65536,
    block_rows: int = 524288,
    sample_rows: int = 1 << 17,
) -> DataFrame:
    """(a, b) links between the distinct fingerprints of ``fps.fp`` whose components are those of
    all pairs within ``radius`` bits.  ``fps`` must be materialised: it is read several times."""
    spark = fps.sparkSession
    total = fps.count()
    leaves = max(1, -(-total // shard_rows))
    bound = min(sample_rows, 2048 * leaves)
    sample = [r.fp for r in hash_share(fps, total, bound).orderBy("h", "fp").limit(bound).collect()]
    sample_fps = np.array(sample, np.int64).view(np.uint64)
    tops = spark.sparkContext.broadcast([build_top(sample_fps, m, radius // 2, leaves) if total else [0] for m in HALVES])
    t = radius // 2

    def rows(batches, blocks) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for f, mask in enumerate(HALVES):
                for shard, some, guest in route(tops.value[f], fp, mask, t):
                    n_home, n_guest = blocks.get((f, shard), (1, 1))
                    salt = (some * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    for h in range(n_home):
                        for g in range(n_guest):
                            as_home = (not guest) & (salt % np.uint64(n_home) == h)
                            as_guest = (guest | (salt % np.uint64(n_home) != h)) & (salt % np.uint64(n_guest) == g)
                            for mine, flag in ((some[as_home], False), (some[as_guest], True)):
                                if n := len(mine):
                                    yield pa.RecordBatch.from_arrays(
                                        [
                                            pa.array(np.full(n, f, np.int32)),
                                            pa.array(np.full(n, shard, np.int64)),
                                            pa.array(np.full(n, h, np.int32)),
                                            pa.array(np.full(n, g, np.int32)),
                                            pa.array(np.full(n, flag)),
                                            pa.array(mine.view(np.int64)),
                                        ],
                                        names=["forest", "shard", "home_block", "guest_block", "guest", "fp"],
                                    )

    def routed(blocks):
        return fps.select("fp").mapInArrow(lambda batches: rows(batches, blocks), ROUTED)

    large: dict[tuple[int, int], list[int]] = {}
    if total > block_rows:
        for r in routed({}).groupBy("forest", "shard", "guest").count().where(F.col("count") > block_rows).collect():
            large.setdefault((r.forest, r.shard), [1, 1])[r.guest] = -(-r["count"] // block_rows)
    blocks = {k: (h, max(g, h)) for k, (h, g) in large.items()}

    def links(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        guest = table.column("guest").to_numpy()
        half = HALVES[table.column("forest")[0].as_py()]
        # signed, so that the smallest node is the one that SQL finds
        found = search(fp[~guest], fp[guest], half, radius)
        a, b = merged((x.view(np.int64), y.view(np.int64)) for x, y in found)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return routed(blocks).groupBy("forest", "shard", "home_block", "guest_block").applyInArrow(links, "a long, b long")


def connected(links: DataFrame, rounds: int = 60, cut=cut) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) but the roots themselves, a root being its
    component's smallest node.

    Alternates large-star and small-star on Spark tables until the links no longer change."""
    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda df: df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    known = state(links)
    for _ in range(rounds):
        if not known.n:
            break
        both = links.union(links.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        near = large.join(low, "a")
        small = near.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        links = cut(small.where("a <> b").distinct())
        now = state(links)
        if now == known:
            break
        known = now
    else:
        raise RuntimeError("components did not settle")
    return links.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _classes(marks: DataFrame, radius: int, shard_rows: int, block_rows: int) -> DataFrame:
    """(fp, root, rep): each distinct fingerprint of ``marks`` (doc_id, fp), its component's
    smallest fingerprint, and its own smallest doc_id."""
    reps = cut(marks.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    nodes = connected(fingerprint_links(reps.select("fp"), radius, shard_rows=shard_rows, block_rows=block_rows))
    return reps.join(nodes, reps.fp == nodes.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")


def near_duplicates(docs: DataFrame, *, width: int = 3, seed: int = 42, radius: int = 3, shard_rows: int = 65536, block_rows: int = 524288) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fp, fingerprint (hex), component_id.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` bits.
    Null or blank text: fingerprint zero, linked like any other.  A null doc_id is kept and joins
    its component without naming it (component_id is null only if all its doc_ids are).  Repeated
    rows come back as often as they came; other columns are not read; an empty table gives none.
    """
    marks = cut(fingerprints(docs.select("doc_id", "text"), width, seed))
    named = _classes(marks, radius, shard_rows, block_rows)
    roots = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = named.join(roots, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marks.join(classes, "fp").select("doc_id", "fp", hexed.alias("fingerprint"), "component_id")


#: Fingerprints of the words' pairs; how far apart those of a group may be that is checked at once.
PAIR_WIDTH, PAIR_RADIUS = 2, 6


def signatures(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """(doc_id, mark, fp, key, n, bits) of every row of ``docs`` (doc_id, mark, text): its fingerprint,
    a hash of its shingle set (texts with one key have similarity 1), the set's size and parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                texts = list(utf8_values(part.column("text")))
                sets = shingles.shingle_hashes(texts)
                fps = np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64)
                sizes = np.array([len(x) for x in sets], np.int64)
                columns = [pa.array(fps), pa.array(shingles.set_keys(sets)), pa.array(sizes), pa.array(shingles.parities(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), *columns], names=["doc_id", "mark", "fp", "key", "n", "bits"])

    return bounded(docs.select("doc_id", "mark", "text")).mapInArrow(run, "doc_id long, mark long, fp long, key long, n long, bits binary")


def keep_one(
    docs: DataFrame,
    *,
    similarity: float = shingles.SIMILARITY,
    width: int = PAIR_WIDTH,
    seed: int = 42,
    radius: int = PAIR_RADIUS,
    shard_rows: int = 65536,
    block_rows: int = 524288,
    block_keys: int = shingles.BLOCK_KEYS,
    block_shingles: int = shingles.BLOCK_SHINGLES,
) -> DataFrame:
    """Exactly one row of ``docs`` for each group of near duplicates, with all its columns: that
    with the smallest doc_id (null last), ties by a hash of the text; of repeated rows one stays.

    Groups are the components of all pairs whose five-word shingles have at least this Jaccard
    similarity, checked exactly; they depend on no order of rows and on no other parameter.  First
    the components of fingerprints of word pairs within ``radius`` bits are checked, which joins
    most copies at little cost.  Then an index of shingles, which misses no pair, proposes what may
    be similar between texts not joined yet.  Texts with the same shingles are one group, whatever
    their fingerprints.  Null and blank texts are alike."""
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("mark")
    texts = docs.select(F.col("doc_id").alias("own_id"), mark, "text")
    weight = F.greatest("n", F.lit(shingles.LEAST_SHINGLES))
    with scratch(docs.sparkSession) as keep:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "n", "bits")).alias("k")
        marks = signatures(docs.select("doc_id", "text", mark), width, seed)
        reps = keep(marks.groupBy("key").agg(F.min("fp").alias("fp"), first), "reps")
        named = reps.select("key", F.col("k.doc_id").alias("rep_id"), F.col("k.mark").alias("rep_mark"))

        fps = keep(reps.select("fp").distinct(), "fingerprints")
        near = connected(fingerprint_links(fps, radius, shard_rows=shard_rows, block_rows=block_rows), cut=keep)
        groups = reps.join(near, reps.fp == near.node, "left").select(F.coalesce("root", "fp").alias("group"), "key", F.col("key").alias("root"), "k.n")
        cells = shingles.dealt_twice(groups, weight, block_shingles)
        nodes = connected(shingles.similar_links(texts, named, cells, similarity, keep), cut=keep)
        classes = keep(reps.join(nodes, reps.key == nodes.node, "left").select("key", F.coalesce("root", "key").alias("root"), "k.n", "k.bits"), "classes")

        links = keep(shingles.proposed_links(texts, classes, similarity, keep, block_keys), "proposed")
        nodes = connected(links, cut=keep)
        met = links.select(F.col("a").alias("key")).union(links.select("b")).distinct()
        met = met.join(nodes, met.key == nodes.node, "left").select("key", F.coalesce("root", "key").alias("group"))
        cells = shingles.dealt(met.join(classes.select("key", "root", "n"), "key"), weight, block_shingles)
        links = shingles.similar_links(texts, named, cells, similarity, keep)
        nodes = connected(classes.where("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")).union(links), cut=keep)

        found = reps.join(nodes, reps.key == nodes.node, "left").select(F.coalesce("root", "key").alias("root"), "k.unnamed", "k.doc_id", "k.mark")
        kept = found.groupBy("root").agg(F.min(F.struct("unnamed", "doc_id", "mark")).alias("k"))
        kept = written(kept.select(F.col("k.doc_id").alias("kept_id"), F.col("k.mark").alias("kept_mark")), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), mark)
    same = F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    numbered = rows.join(kept, same, "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("own_id", "mark").orderBy("mark")))
    return numbered.where("n = 1").select("row.*")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")
