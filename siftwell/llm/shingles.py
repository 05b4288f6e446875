"""Sets of word shingles: their hashes, an index that misses no similar pair, and exact links.

Pairs are never listed for a group.  Rows of a group are *dealt* to cells of bounded size in which
every two rows of different roots meet; a cell returns a spanning forest.  ``proposed_links`` does
so with sizes and parities of the sets (a superset of the similar pairs, as a forest), ``similar_links``
with the sets themselves, so that its links are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.arrowtext import bounded, give_back, slices, utf8_values
from siftwell.llm.wordhash import LANE_BASES, runs, windows, word_hashes, words

SHINGLE, SIMILARITY = 5, 0.8
#: Least and most bits of a set's parities; texts sampled for the order of shingles, and how many common ones it knows.
BITS, SAMPLED_TEXTS, COMMON = (512, 1 << 16), 8192, 1 << 16
#: Keys of a block of the index; shingles of a block of sets, and what a set counts at least there.
BLOCK_KEYS, BLOCK_SHINGLES, LEAST_SHINGLES = 512, 1 << 19, 128
#: Rows of the list of texts to compare up to which it is broadcast (some ten longs each).
COMPARED_ROWS = 100_000


def shingle_hashes(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's lower-cased word shingles; a shorter text has one."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    array = np.frombuffer(b"".join(texts).lower(), np.uint8)
    starts, stops, first = words(array, ends)
    hashes = word_hashes(array, starts, stops)
    at, h = windows(hashes, first, width)
    bounds = np.searchsorted(at, first)
    out = []
    for r in range(len(texts)):
        own = h[bounds[r] : bounds[r + 1]]
        if not len(own) and first[r] < first[r + 1]:
            own = runs(hashes, first[r : r + 1], first[r + 1 : r + 2], LANE_BASES[0])
        out.append(np.unique(own))
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)


def parities(sets: list[np.ndarray]) -> list[bytes]:
    """Packed bits of each set, twice its size of them in a power of two within ``BITS``: of how many
    of its hashes fall on a place, whether that is odd.  Two sets' bits, the longer folded to the
    shorter, differ in at most as many places as there are hashes that only one set has."""
    out = []
    for x in sets:
        width = min(BITS[1], max(BITS[0], 1 << (2 * len(x)).bit_length()))
        place = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(width - 1)
        out.append(np.packbits((np.bincount(place.astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes())
    return out


class Compared:
    """Rows of cells, with the sizes and parities of their sets."""

    def __init__(self, cell, block, diagonal, label, n, bits: list[bytes], similarity: float):
        self.cell, self.block, self.diagonal, self.label, self.n = cell, block, diagonal, label, n
        self.flat = np.frombuffer(b"".join(bits), np.uint64)
        self.first = np.concatenate([[0], np.cumsum([len(b) // 8 for b in bits])]).astype(np.int64)
        self.similarity = similarity

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """In how many places the parities of rows ``x`` and ``y`` differ.  Lengths that differ by
        more than double count 0."""
        first, flat = self.first, self.flat
        wx, wy = first[x + 1] - first[x], first[y + 1] - first[y]
        out, low = np.zeros(len(x), np.int64), np.minimum(wx, wy)
        for m in np.unique(low).tolist():
            some = np.flatnonzero((low == m) & (np.maximum(wx, wy) <= 2 * m))
            for part in np.split(some, range(1 << 11, len(some), 1 << 11)):
                sides = []
                for rows, words_of in ((x[part], wx[part]), (y[part], wy[part])):
                    at = first[rows][:, None] + np.arange(m)
                    own, long = flat[at], words_of > m
                    own[long] ^= flat[at[long] + m]
                    sides.append(own)
                out[part] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1)
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (x, y) rows of one cell, and of different labels and blocks (in a diagonal cell also
        of one block), whose sizes and parities allow the similarity.  Rows must be sorted by cell;
        labels may change between parts."""
        cell, block, n, similarity = self.cell, self.block, self.n, self.similarity
        at, step = np.arange(len(cell)), 0
        while len(at):
            step += 1
            at = at[: np.searchsorted(at, len(cell) - step)]
            at = at[cell[at] == cell[at + step]]
            x = at[(self.label[at] != self.label[at + step]) & (self.diagonal[at] | (block[at] != block[at + step]))]
            y = x + step
            total, low = n[x] + n[y], np.minimum(n[x], n[y])
            # sets of that similarity share at least similarity / (1 + similarity) of their sizes' sum
            near = low + 1e-6 >= similarity * (total - low)
            x, y, most = x[near], y[near], (total * (1 - similarity) / (1 + similarity) + 1e-6)[near]
            near = self.apart(x, y) <= most
            if near.any():
                yield x[near], y[near]


def merged(links: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """``forest`` of links that come in parts, holding about ``most`` links besides the forest."""
    left, right, held = [], [], 0
    for a, b in links:
        left.append(a)
        right.append(b)
        held += len(a)
        if held > most:
            a, b = forest(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(left), np.concatenate(right))


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for the nodes of a list of links, roots left out."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in set(zip(ends[: len(left)].tolist(), ends[len(left) :].tolist())):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.fromiter((root(i) for i in range(len(nodes))), np.int64, len(nodes))
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def link_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


# -- dealing --------------------------------------------------------------------------------------


def dealt(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """``rows`` (group, key, root, ...) with columns cell, block, diagonal: every two rows of one
    group and different roots meet in a cell, which holds two blocks of about ``limit`` weight at
    most.  Rows of a group's heaviest root do not meet each other, so that a group which is almost
    one root takes cells in proportion to its size.  Groups of one root are left out."""
    roots = rows.groupBy("group", "root").agg(F.sum(weight).alias("w"))
    groups = roots.groupBy("group").agg(F.sum("w").alias("all"), F.max(F.struct("w", "root")).alias("top"), F.count("*").alias("roots"))
    groups = groups.where("roots > 1").select("group", "all", "top")
    large = F.col("all") > limit
    others = F.when(large, F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.w")) / limit))).otherwise(1)
    tops = F.when(large, F.ceil(F.col("top.w") / limit)).otherwise(0)
    is_top = large & (F.col("root") == F.col("top.root"))
    number = F.xxhash64("key")
    block = F.when(is_top, F.col("n_others") + F.pmod(number, F.greatest(F.col("n_tops"), F.lit(1)))).otherwise(F.pmod(number, F.col("n_others")))
    partners = F.sequence(F.lit(0).cast("long"), F.when(is_top, F.col("n_others")).otherwise(F.col("n_others") + F.col("n_tops")) - 1)
    numbered = rows.join(groups, "group").withColumns({"n_others": others.cast("long"), "n_tops": tops.cast("long")})
    met = numbered.withColumns({"block": block.cast("long"), "other": F.explode(partners)})
    cell = F.xxhash64("group", F.least("block", "other"), F.greatest("block", "other"))
    return met.select(cell.alias("cell"), "block", (F.col("block") == F.col("other")).alias("diagonal"), *rows.columns)


def dealt_twice(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """``rows`` (group, key, root, ...) with columns cell, block, diagonal: a group above ``limit``
    weight is cut into blocks in two ways, so that each row meets those of two blocks; linear in the
    size of a group, and enough to join dense ones."""
    groups = rows.groupBy("group").agg(F.sum(weight).alias("all"), F.count("*").alias("n_rows")).where("n_rows > 1")
    blocks = F.ceil(F.col("all") / limit)
    ways = F.explode(F.when(blocks > 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    met = rows.join(groups, "group").select(*rows.columns, blocks.alias("blocks"), ways.alias("way"))
    cell = F.xxhash64("group", "way", F.pmod(F.xxhash64("key", "way"), "blocks"))
    return met.select(cell.alias("cell"), F.lit(0).cast("long").alias("block"), F.lit(True).alias("diagonal"), *rows.columns)


# -- exact links ----------------------------------------------------------------------------------


def similar_links(texts: DataFrame, named: DataFrame, cells: DataFrame, similarity: float, keep: Callable) -> DataFrame:
    """(a, b) links of keys whose sets have the similarity; the components they make with the roots
    are those of all such pairs that meet in a cell.

    ``cells`` (cell, block, diagonal, key, root, n) comes from ``dealt`` or ``dealt_twice``; ``named``
    (key, rep_id, rep_mark) names a text of each key, ``texts`` has own_id, mark, text.  ``keep``
    materialises a table.  Each set is sent once to each of its cells."""
    asked = cells.groupBy("key").agg(F.sum(F.greatest("n", F.lit(LEAST_SHINGLES))).alias("w"), F.collect_list(F.struct("cell", "block", "diagonal", "root")).alias("cells"))
    asked = keep(asked.join(named, "key"), "asked")
    rows, load = asked.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    shards = max(1, round(load / BLOCK_SHINGLES))
    side = F.broadcast(asked) if rows <= COMPARED_ROWS else asked
    same = F.col("own_id").eqNullSafe(F.col("rep_id")) & (F.col("mark") == F.col("rep_mark"))
    wanted = texts.join(side, same).select("key", "cells", "text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                sets = [x.tobytes() for x in shingle_hashes(list(utf8_values(part.column("text"))))]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("cells"), pa.array(sets, pa.binary())], names=["key", "cells", "shingles"])

    schema = "key long, cells array<struct<cell: long, block: long, diagonal: boolean, root: long>>, shingles binary"
    sets = bounded(wanted).mapInArrow(shingles, schema).select("key", F.explode("cells").alias("c"), "shingles")
    sharded = sets.select(F.pmod(F.xxhash64("c.cell"), F.lit(shards)).alias("shard"), "c.cell", "c.block", "c.diagonal", "key", "c.root", "shingles")
    return sharded.groupBy("shard").applyInArrow(lambda table: checked_links(table, similarity), "a long, b long")


def ordered(table: pa.Table) -> tuple[np.ndarray, Callable[[str], np.ndarray]]:
    """(row numbers by cell and key without repeats, reader of a column in that order)."""
    column = lambda name: table.column(name).to_numpy()
    order = np.lexsort((column("key"), column("cell")))
    cell, key = column("cell")[order], column("key")[order]
    order = order[np.append(True, (cell[1:] != cell[:-1]) | (key[1:] != key[:-1]))[: len(order)]]
    return order, lambda name: column(name)[order]


def checked_links(table: pa.Table, similarity: float) -> pa.Table:
    """A spanning forest, between roots, of the pairs of a cell that have the similarity."""
    order, column = ordered(table)
    values = [x for c in table.column("shingles").chunks for x in utf8_values(c)]
    sets = [np.frombuffer(values[i], np.uint64) for i in order.tolist()]
    cell, key, n = column("cell"), column("key"), np.array([len(x) for x in sets], np.int64)
    # a root is its own tree in each cell: cells are independent
    label = np.unique(np.stack([cell, column("root")]), axis=1, return_inverse=True)[1].reshape(-1).copy()
    rows, found = Compared(cell, column("block"), column("diagonal"), label, n, parities(sets), similarity), []
    for x, y in rows.pairs():
        for i, k in zip(x.tolist(), y.tolist()):
            if label[i] == label[k]:
                continue
            shared = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if shared >= similarity * (n[i] + n[k] - shared):
                found.append((key[i], key[k]))
                label[label == label[k]] = label[i]
    links = np.array(found, np.int64).reshape(-1, 2)
    del rows, sets, values
    give_back()
    return link_table(links[:, 0].copy(), links[:, 1].copy())


# -- index ----------------------------------------------------------------------------------------


def common_shingles(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of shingles that several texts of a bounded sample share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                sets = shingle_hashes(list(utf8_values(part.column("text"))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["token"])

    some = docs.where(F.pmod("mark", F.lit(max(1, total // SAMPLED_TEXTS))) == 0).select("text")
    counts = bounded(some).mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 2")
    found = counts.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    tokens = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found.column("n").to_numpy()[order]


def prefixes(sets: list[np.ndarray], common: tuple[np.ndarray, np.ndarray], similarity: float) -> list[np.ndarray]:
    """Of each set the first hashes in one order of all hashes (rare before common ones), so many
    that any two sets of at least this similarity have one of them in common."""
    tokens, counts = common
    out = []
    for x in sets:
        size = len(x) - math.ceil(similarity * len(x) - 1e-9) + 1 if len(x) else 0
        if len(tokens) and size:
            at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
            weight = np.where(tokens[at] == x, counts[at], 0)
            x = x if not weight[:size].any() else x[np.argsort(weight, kind="stable")]
        out.append(x[:size])
    return out


def shared_prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float, total: int, shingles: int) -> DataFrame:
    """(token, key): every hash that the prefixes of several keys hold, with each of them."""
    buckets = max(64, round(shingles * (1 - similarity) + total) >> 17)
    known = docs.sparkSession.sparkContext.broadcast(common)

    def packed(tokens: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        t, k = np.concatenate(tokens), np.concatenate(keys)
        bucket = ((t >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        pairs = np.stack([t.view(np.int64)[order], k[order]], axis=1)
        found, at = np.unique(bucket[order], return_index=True)
        rows = [x.tobytes() for x in np.split(pairs, at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(rows, pa.binary())], names=["bucket", "pairs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, held, seen = [], [], 0, set()
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                sets = shingle_hashes(list(utf8_values(part.column("text"))))
                own = set_keys(sets)
                fresh = [i for i, k in enumerate(own.tolist()) if len(sets[i]) and not (k in seen or seen.add(k))]
                found = prefixes([sets[i] for i in fresh], known.value, similarity)
                tokens += found
                keys += [np.full(len(x), own[i]) for i, x in zip(fresh, found)]
                held += sum(map(len, found))
                if held >= 1 << 18:
                    yield packed(tokens, keys)
                    tokens, keys, held, seen = [], [], 0, set()
        if held:
            yield packed(tokens, keys)

    def shared(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.int64).reshape(-1, 2) for c in table.column("pairs").chunks for x in utf8_values(c)]
        pairs = np.concatenate(rows)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))]
        _, which, sizes = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
        pairs = pairs[sizes[which] > 1]
        return pa.table({"token": pa.array(pairs[:, 0].copy()), "key": pa.array(pairs[:, 1].copy())})

    return bounded(docs.select("text")).mapInArrow(run, "bucket long, pairs binary").groupBy("bucket").applyInArrow(shared, "token long, key long")


def possible_links(table: pa.Table, similarity: float) -> pa.Table:
    """A spanning forest of the pairs of a cell, of different roots, that may have the similarity."""
    order, column = ordered(table)
    values = [x for c in table.column("bits").chunks for x in utf8_values(c)]
    key = column("key")
    rows = Compared(column("cell"), column("block"), column("diagonal"), column("root"), column("n"), [values[i] for i in order.tolist()], similarity)
    return link_table(*merged((key[x], key[y]) for x, y in rows.pairs()))


def proposed_links(docs: DataFrame, classes: DataFrame, similarity: float, keep: Callable, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """(a, b) links of keys: each pair of keys with different roots that can have the similarity is
    joined by a path of them, and each linked key is in such a pair.  Sets that have it share a hash
    of their prefixes.  ``docs`` has text and mark; ``classes`` (key, root, n, bits) is materialised."""
    total, shingles = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = shared_prefixes(docs, common_shingles(docs, total), similarity, total, shingles)
    held = keep(held.join(classes.select("key", "root"), "key").withColumnRenamed("token", "group"), "prefixes")
    cells = keep(dealt(held, F.lit(1), block_keys).select("cell", "block", "diagonal", "key"), "cells")
    shards = max(1, cells.count() // (2 * block_keys))
    rows = cells.join(classes, "key").withColumn("shard", F.pmod(F.xxhash64("cell"), F.lit(shards)))
    sharded = rows.select("shard", "cell", "block", "diagonal", "key", "root", "n", "bits")
    return sharded.groupBy("shard").applyInArrow(lambda table: possible_links(table, similarity), "a long, b long").distinct()
