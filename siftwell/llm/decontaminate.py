"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters leaks into a document if some region of the document is within
``e = min(floor(rate * m), (m - q) // q)`` edits of the whole item (after lower-casing and collapsing
white space).  Each edit destroys at most q of the item's m - q + 1 q-grams, so such a region shares
at least ``m - q + 1 - q * e`` of them, all on diagonals (text position - item position) that spread
over at most e.  Bands of 2 (e + 1) diagonals that overlap by half contain every such spread.  So the
filter counts shared q-grams by document, item and band, and loses no region; bands that reach the
bound are verified by an alignment restricted to the band.

The q-gram index of a block of items goes to every task; items are taken in blocks of at most
``block_chars`` characters, which bounds the index.  Documents stay where they are: no shuffle.  Of
several blocks one index is alive at a time: what a block but the last finds, which is small beside the
documents, is written to shared storage, and its index destroyed before the next is built.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.arrowtext import bounded, slices, utf8_parts
from siftwell.llm.storage import written

Q = 12
RATE = 0.05
BLOCK_CHARS = 4 << 20
#: Pairs of equal q-grams (in a text and in items) that are laid out at a time.
CHUNK_PAIRS = 1 << 18
#: Random odd multipliers of the rolling hash and of its spread over the first-look table.
BASE, SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
TABLE_BITS = 22

MATCHES = "doc_id long, item_id long, start long, end long, edits int, shared long"


def _lower_table() -> np.ndarray:
    """Code point -> its single lower-case code point, for the basic plane."""
    table = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


LOWER = _lower_table()
SPACE = np.array([chr(c).isspace() for c in range(1 << 16)])


def normalise(points: np.ndarray, fresh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased code points with white space collapsed, their positions before).  ``fresh`` are
    positions where a new text starts, so that white space does not run over from the last one."""
    small = points < (1 << 16)
    low = np.where(small, LOWER[np.where(small, points, 0)], points).astype(np.uint32)
    space = SPACE[np.where(small, points, 0)]
    after = np.zeros(len(points), bool)
    after[1:] = space[:-1]
    if fresh is not None:
        after[fresh[fresh < len(points)]] = False
    kept = np.flatnonzero(~(space & after))
    low[space] = 32
    return low[kept], kept


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q-gram."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, width, base = points.astype(np.uint64), 1, BASE
    out, done, factor = np.zeros(n, np.uint64), 0, 1
    while True:  # windows of 1, 2, 4, ... characters make up one of q
        if q & width:
            out += power[done : done + n] * np.uint64(factor)
            done, factor = done + width, factor * base % (1 << 64)
        if 2 * width > q:
            return out
        power = power[: len(power) - width] + power[width:] * np.uint64(base)
        base, width = base * base % (1 << 64), 2 * width


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: list[int | None]
    items: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    short: dict[bytes, list[int]]
    q: int


def build_index(rows: list[tuple[int | None, str]], q: int = Q, rate: float = RATE) -> Index:
    ids, items, short = [], [], {}
    for item_id, text in rows:
        points = normalise(points_of(text.strip()))[0]
        if len(points) >= q:
            ids.append(item_id)
            items.append(points)
        elif len(points):
            short.setdefault(points.tobytes(), []).append(item_id)
    sizes = np.array([len(x) for x in items], np.int64)
    budgets = np.minimum(np.floor(rate * sizes + 1e-9).astype(np.int64), (sizes - q) // q)
    grams = [gram_hashes(x, q) for x in items]
    every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    item = np.repeat(np.arange(len(items)), [len(g) for g in grams]).astype(np.int64)
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(every, kind="stable")
    hashes, first = np.unique(every[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(hashes * np.uint64(SPREAD)) >> np.uint64(64 - TABLE_BITS)] = True
    first = np.append(first, len(every)).astype(np.int64)
    return Index(ids, items, budgets, sizes - q + 1 - q * budgets, hashes, first, item[order], place[order], table, short, q)


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, free: bool, most: int) -> tuple[int, int] | None:
    """(edits, end in ``text``) of the best alignment of the whole item on diagonals low..high, or
    None above ``most`` edits.  It may start anywhere if ``free``, else at the text's start.  Beyond
    the text's ends a character matches nothing, which costs what leaving it out does."""
    pad = len(item) + high - low + abs(low) + abs(high) + 2
    around = np.full(len(text) + 2 * pad, 0xFFFFFFFF, np.uint32)
    around[pad : pad + len(text)] = text
    step = np.arange(high - low + 1)
    cost = np.zeros(len(step), np.int64) if free else np.abs(step + low)
    for i, c in enumerate(item.tolist(), 1):
        letters = around[pad + i + low - 1 : pad + i + high]
        best = cost + (letters != c)
        best[:-1] = np.minimum(best[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(best - step) + step
        if cost.min() > most:
            return None
    at = int(cost.argmin())
    return int(cost[at]), min(max(0, len(item) + low + at), len(text))


def region(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best region of ``text`` on diagonals low..high within budget."""
    m = len(item)
    for start in range(max(0, low), min(high, len(text) - m) + 1) if high - low < 64 else ():
        if text[start] == item[0] and (text[start : start + m] == item).all():
            return 0, start, start + m
    forward = banded(item, text, low, high, True, budget)
    if forward is None:
        return None
    edits, end = forward
    back = banded(item[::-1], text[:end][::-1], -budget, budget, False, budget)
    return edits, max(0, end - back[1]) if back else max(0, end - m), end


def find_matches(index: Index, array: np.ndarray, ends: np.ndarray) -> list[tuple[int, int | None, int, int, int, int]]:
    """(row, item_id, start, end, edits, shared q-grams) in the texts of a UTF-8 buffer."""
    points = points_of(array.tobytes().decode("utf-8"))
    leads = np.concatenate([[0], np.cumsum((array & 0xC0) != 0x80)])
    starts = leads[ends]  # each text's first code point
    text, kept = normalise(points, starts[:-1])
    bounds = np.searchsorted(kept, starts)  # each text's first normalised character
    found = []
    if index.short:
        for row in range(len(ends) - 1):
            own = text[bounds[row] : bounds[row + 1]]
            if 0 < len(own) <= index.q + 1:
                edge = own.tobytes().decode("utf-32-le").strip()
                for item_id in index.short.get(points_of(edge).tobytes(), ()):
                    found.append((row, item_id, 0, int(starts[row + 1] - starts[row]), 0, 0))
    if not len(index.hashes):
        return found
    hashes = gram_hashes(text, index.q)
    near = np.flatnonzero(index.table[(hashes * np.uint64(SPREAD)) >> np.uint64(64 - TABLE_BITS)])
    which = np.minimum(np.searchsorted(index.hashes, hashes[near]), len(index.hashes) - 1)
    exact = index.hashes[which] == hashes[near]
    near, which = near[exact], which[exact]
    row = np.searchsorted(bounds, near, side="right") - 1
    inside = near + index.q <= bounds[row + 1]
    near, which, row = near[inside], which[inside], row[inside]
    if not len(near):
        return found
    # every occurrence of each shared q-gram in the items, some at a time, summed by pair and band
    counts = index.first[which + 1] - index.first[which]
    ends_of = np.cumsum(counts)
    low, span = -len(text) - int(index.place.max()) - 2, 2 * (len(text) + int(index.place.max()) + 4)
    keys, shared, begin = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while begin < len(near):
        before = ends_of[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends_of, before + CHUNK_PAIRS, side="right")))
        own, n = slice(begin, end), counts[begin:end]
        at = np.repeat(index.first[which[own]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        item, rows = index.item[at], np.repeat(row[own], n)
        band = (np.repeat(near[own], n) - index.place[at] - bounds[rows]) // (index.budgets[item] + 1)
        # each hit lies in two overlapping bands: (band - 1) and band
        first_key = (rows * len(index.items) + item) * span + (band - low)
        found_keys, times = np.unique(np.concatenate([first_key - 1, first_key]), return_counts=True)
        keys, where = np.unique(np.concatenate([keys, found_keys]), return_inverse=True)
        shared = np.bincount(where, np.concatenate([shared, times]), len(keys)).astype(np.int64)
        begin = end
    key_pair, key_band = keys // span, keys % span + low
    key_item = key_pair % len(index.items)
    passed = np.flatnonzero(shared >= index.bounds[key_item])
    best: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
    for k in passed.tolist():
        r, i, w = int(key_pair[k] // len(index.items)), int(key_item[k]), int(index.budgets[key_item[k]]) + 1
        own = text[bounds[r] : bounds[r + 1]]
        low_d = int(key_band[k]) * w
        start = max(0, low_d)
        stop = min(len(own), low_d + 2 * w + len(index.items[i]))
        hit = region(index.items[i], own[start:stop], low_d - start, low_d + 2 * w - 1 - start, w - 1)
        if hit:
            best.setdefault((r, i), []).append((hit[0], start + hit[1], start + hit[2], int(shared[k])))
    for (r, i), hits in sorted(best.items()):
        taken: list[tuple[int, int]] = []  # disjoint, by place
        for edits, start, end, n in sorted(hits):
            place = bisect(taken, (start, end))
            if (place == 0 or taken[place - 1][1] <= start) and (place == len(taken) or end <= taken[place][0]):
                taken.insert(place, (start, end))
                first = int(kept[bounds[r] + start] - starts[r])
                last = int(kept[bounds[r] + end - 1] - starts[r]) + 1 if end > start else first
                found.append((r, index.ids[i], first, last, edits, n))
    return found


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    """The items in blocks of bounded size, fetched one after another, and whether it is the last."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        if block and size + len(r.text) > block_chars:
            yield block, False
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block, True


def _matched(docs: DataFrame, index, marked: bool = False) -> DataFrame:
    """``MATCHES`` of ``docs`` (doc_id, text) with one broadcast index; if ``marked`` with a column
    ``mark`` in front, a hash of the text."""
    names = ["mark", "doc_id"] if marked else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                rows = find_matches(index.value, *utf8_parts(part.column("text")))
                own = [part.column(c).take(pa.array([r[0] for r in rows], pa.int64())) for c in names]
                rest = [pa.array([r[k] for r in rows], pa.int32() if k == 4 else pa.int64()) for k in range(1, 6)]
                yield pa.RecordBatch.from_arrays([*own, *rest], names=[*names, "item_id", "start", "end", "edits", "shared"])

    rows = docs.select(F.xxhash64("text").alias("mark"), "doc_id", "text") if marked else docs.select("doc_id", "text")
    return bounded(rows).mapInArrow(run, ("mark long, " if marked else "") + MATCHES)


def matches(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Leaked regions: doc_id, item_id, start, end (code points of the text, end exclusive), edits,
    shared (q-grams in the band).  Regions of one item in one document do not overlap.

    Null texts and items, and blank items, match nothing.  An item of fewer than q characters
    matches a document only if that is all its text.  Repeated documents and items each give their
    rows; null ids are kept; other columns are not read; empty tables give none.
    """
    spark = docs.sparkSession
    found = []
    for block, last in _blocks(benchmark, block_chars):
        index = spark.sparkContext.broadcast(build_index(block, q, rate))
        found.append(_matched(docs, index))
        if not last:
            found[-1] = written(found[-1], "leaks")
            index.destroy()
    return reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], MATCHES)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the rows in which a benchmark item leaks; all columns stay.

    Blocks before the last leave a list of the leaking rows (doc_id and a hash of the text), which a
    null-safe anti-join takes out; with one block there is no join."""
    spark = docs.sparkSession
    for block, last in _blocks(benchmark, block_chars):
        index = spark.sparkContext.broadcast(build_index(block, q, rate))
        if not last:
            found = written(_matched(docs, index, marked=True).select(F.col("doc_id").alias("leak_id"), F.col("mark").alias("leak_mark")).distinct(), "leaks")
            index.destroy()
            whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_mark"))
            same = F.col("own_id").eqNullSafe(F.col("leak_id")) & (F.col("own_mark") == F.col("leak_mark"))
            docs = whole.join(found, same, "left_anti").select("row.*")
            continue

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", 2 << 20):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r[0] for r in find_matches(index.value, *utf8_parts(part.column("text")))]] = False
                    yield part if clean.all() else part.filter(pa.array(clean))

        return bounded(docs).mapInArrow(run, docs.schema)
    return docs


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
