"""Exact substring dedup by fixed-block anchors.

A word is removed when a window of ``window`` words around it also starts in a document with a
smaller doc_id.  With blocks of half a window, every window holds one whole block of the grid of its
own text.

1. Index: the hashes of all non-overlapping blocks, as a blocked Bloom filter.
2. Probe: every rolling window of block length of every text; hits go to an exact group-by, which
   keeps the hashes of two or more documents with their smallest document and a place in it.
3. Extend: a text's neighbouring blocks that lie side by side in the same smaller document form one
   exact repeat; where it is a window or longer its inside is settled.  Only windows that hold a hit
   block and reach past settled repeats remain open, a few at each end.
4. Settle: all rolling windows are probed against the open ones (again a filter, then an exact
   group-by), which extends each repeat to its maximum, with whichever document repeats it.

Filters are broadcast in slices of the hash range, none above ``filter_bytes``, with a pass over the
texts for each, so that what a pass writes stays in proportion to the repeats.  Hashes are 128 bits wide.  Groups are reduced to their
smallest document before and in the shuffle; no pairs of documents are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.arrowtext import bounded, slices, utf8_parts
from siftwell.llm.storage import scratch, written
from siftwell.llm.wordhash import windows, word_hashes, words

WINDOW = 50
FILTER_BYTES = 128 << 20
#: Bytes of per-document lists up to which they are broadcast to the texts.
LIST_BYTES = 32 << 20
#: Bits of a filter for each key, up to twice as many as sizes are powers of two.
BITS_PER_KEY = 8


# -- blocked Bloom filters ------------------------------------------------------------------------


def filter_bits(h: np.ndarray) -> np.ndarray:
    """Four bits in a 64-bit block, from the low 24 bits of the hash."""
    one = np.uint64(1)
    out = np.zeros(len(h), np.uint64)
    for i in range(4):
        out |= one << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return out


@dataclass
class Slice:
    """The filter of the hashes whose first ``bits`` bits are ``number``."""

    number: int
    bits: int
    table: np.ndarray

    def might_hold(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash is of this slice and may be in the filter."""
        own = h << np.uint64(self.bits) if self.bits else h
        mask = filter_bits(h)
        held = self.table[own >> np.uint64(64 - (len(self.table).bit_length() - 1))] & mask == mask
        return held & (h >> np.uint64(64 - self.bits) == self.number) if self.bits else held


def filter_slices(hashes: DataFrame, filter_bytes: int) -> Iterator[Slice]:
    """A blocked Bloom filter of the distinct ``hashes.h`` (materialised), one slice of the hash range
    after another, none above ``filter_bytes`` (8 KB at least).  Segments are built by tasks; only
    the finished ones of a slice come to the driver."""
    power = max(10, (hashes.count() * BITS_PER_KEY // 64).bit_length())
    most = max(10, (filter_bytes // 8).bit_length() - 1)
    bits, power = max(0, power - most), min(power, most)
    part = min(power, 15)  # blocks of a segment, as a power of two

    def segment(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy().view(np.uint64)
        blocks = np.zeros(1 << part, np.uint64)
        at = (h >> np.uint64(64 - bits - power)) & np.uint64((1 << part) - 1)
        np.bitwise_or.at(blocks, at.astype(np.int64), filter_bits(h))
        return pa.table({"seg": table.column("seg")[:1], "bits": pa.array([blocks.tobytes()], pa.binary())})

    segments = F.shiftrightunsigned("h", 64 - bits - power + part).bitwiseAND((1 << (power - part)) - 1) if power > part else F.lit(0).cast("long")
    for number in range(1 << bits):
        own = hashes.where(F.shiftrightunsigned("h", 64 - bits) == number) if bits else hashes
        table = np.zeros(1 << power, np.uint64)
        for r in own.select("h", segments.alias("seg")).groupBy("seg").applyInArrow(segment, "seg long, bits binary").collect():
            table[r.seg << part : (r.seg + 1) << part] = np.frombuffer(r.bits, np.uint64)
        yield Slice(number, bits, table)


# -- passes over the texts ------------------------------------------------------------------------


class Texts:
    """Word hashes of an Arrow slice of (doc_id, mark, text), texts under ``least`` words left out
    of windows."""

    def __init__(self, part: pa.RecordBatch, least: int):
        array, ends = utf8_parts(part.column("text"))
        starts, stops, first = words(array, ends)
        self.hashes, self.first = word_hashes(array, starts, stops), first
        self.doc_id = part.column("doc_id").to_numpy(zero_copy_only=False)
        self.mark = part.column("mark").to_numpy(zero_copy_only=False)
        self.long = np.diff(first) >= least

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position in the row's text, hash) of windows of texts that are long enough."""
        at, h = windows(self.hashes, self.first, width)
        row = np.searchsorted(self.first, at, side="right") - 1
        keep = self.long[row]
        return row[keep], at[keep] - self.first[row[keep]], h[keep]

    def second(self, row: np.ndarray, position: np.ndarray, width: int) -> np.ndarray:
        """The second lane of some windows."""
        at, h = windows(self.hashes, self.first, width, 1)
        return h[np.searchsorted(at, self.first[row] + position)]


def _over(docs: DataFrame, schema: str, make: Callable[[pa.RecordBatch], list[np.ndarray]]) -> DataFrame:
    """A pass over slices of texts that gives columns as numpy arrays."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                columns = [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in make(part)]
                for start in range(0, len(columns[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([c.slice(start, 1 << 18) for c in columns], names=names)

    return bounded(docs).mapInArrow(run, schema)


def _side(lists: DataFrame, weight: str, keep: Callable = written) -> DataFrame:
    """``lists`` materialised, and broadcast if its lists are small enough in all."""
    lists = keep(lists, "lists")
    size = lists.agg((F.sum(F.expr(weight)) + F.count("*") * 64).alias("n")).first().n or 0
    return F.broadcast(lists) if size <= LIST_BYTES else lists


def open_windows(n_words: int, places: list[tuple[int, int, int]], window: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(settled intervals of words, starts of windows left open) of one text.  ``places``: for each
    hit block its position, the smallest document that has it and the place there, by position."""
    block = window // 2
    settled, starts = [], np.zeros(max(0, n_words - window + 1) + 1, np.int64)
    i = 0
    while i < len(places):
        k = i
        while k + 1 < len(places) and all(places[k + 1][x] - places[k][x] == (block, 0, block)[x] for x in range(3)):
            k += 1
        first, last = places[i][0], places[k][0] + block
        if last - first >= window:
            settled.append((first, last))
        low, high = max(0, first - (window - block)), min(n_words - window, last - block)
        if low <= high:  # windows that hold a block of this run
            starts[low] += 1
            starts[high + 1] -= 1
        i = k + 1
    wanted = np.cumsum(starts)[:-1] > 0
    for first, last in settled:
        wanted[first : last - window + 1] = False
    return settled, np.flatnonzero(wanted)


def _probed(docs: DataFrame, schema: str, probe: Callable, slices_of: Iterator[Slice], keep: Callable, reduce_=lambda x: x) -> DataFrame:
    """A pass over the texts for each slice of a filter; what they give is disjoint and materialised."""
    done = []
    for one in slices_of:
        shared = docs.sparkSession.sparkContext.broadcast(one)
        done.append(keep(reduce_(_over(docs, schema, lambda part, shared=shared: probe(part, shared.value))), "probed"))
        shared.unpersist()
    return reduce(DataFrame.unionAll, done)


def repeated_words(docs: DataFrame, keep: Callable, window: int = WINDOW, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, mark, intervals) for texts with words to remove; ``docs`` has doc_id, mark, text.
    Intervals (start, end in words) are sorted, disjoint and complete.  ``keep`` materialises."""
    if window < 2 or window % 2:
        raise ValueError("the window must be an even number of words")
    block = window // 2

    def index(part: pa.RecordBatch) -> list[np.ndarray]:
        _, position, h = Texts(part, window).windows(block)
        return [np.unique(h[position % block == 0])]

    blocks = keep(_over(docs, "h long", index).distinct(), "blocks")

    def probe(part: pa.RecordBatch, anchors: Slice) -> list[np.ndarray]:
        texts = Texts(part, window)
        row, position, h = texts.windows(block)
        hit = anchors.might_hold(h)
        row, position, h = row[hit], position[hit], h[hit]
        place = (texts.mark[row] << 32) | position
        return [h, texts.second(row, position, block), texts.doc_id[row], place, position % block == 0]

    hits = _probed(docs, "h long, g long, doc_id long, place long, own boolean", probe, filter_slices(blocks, filter_bytes), keep)
    shared = hits.groupBy("h", "g").agg(F.min("doc_id").alias("low"), F.min_by("place", "doc_id").alias("low_place"), F.max("doc_id").alias("high"))
    # materialised, so that the join below shuffles both sides and a hot hash can be split there
    shared = keep(shared.where("low < high").select("h", "g", "low", "low_place"), "shared")
    own = hits.where("own").join(shared, ["h", "g"]).where("doc_id > low")
    own = own.select("doc_id", F.shiftright("place", 32).alias("mark"), F.struct(F.col("place").bitwiseAND((1 << 32) - 1).alias("at"), "low", "low_place").alias("p"))
    # one row per text: its hit blocks, at most its own length
    listed = _side(own.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("p")).alias("places")), "size(places) * 24", keep)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = Texts(part, window)
                out: list[tuple] = []
                row, position, h = texts.windows(window)
                first = np.searchsorted(row, np.arange(part.num_rows))
                picked = []
                for r, places in enumerate(part.column("places").to_pylist()):
                    n = int(texts.first[r + 1] - texts.first[r])
                    settled, starts = open_windows(n, [(p["at"], p["low"], p["low_place"]) for p in places], window)
                    out += [(int(texts.doc_id[r]), int(texts.mark[r]), None, None, a, b) for a, b in settled]
                    picked.append(first[r] + starts)
                at = np.concatenate(picked) if picked else np.zeros(0, np.int64)
                row, position, h = row[at], position[at], h[at]
                second = texts.second(row, position, window)
                columns = [
                    np.concatenate([np.array([o[0] for o in out], np.int64), texts.doc_id[row]]),
                    np.concatenate([np.array([o[1] for o in out], np.int64), texts.mark[row]]),
                ]
                nulls = pa.nulls(len(out), pa.int64())
                arrays = [pa.array(c) for c in columns]
                arrays += [pa.concat_arrays([nulls, pa.array(v.view(np.int64))]) for v in (h, second)]
                arrays += [pa.array(np.concatenate([np.array([o[4] for o in out], np.int64), position])), pa.array(np.concatenate([np.array([o[5] for o in out], np.int64), position + window]))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", "h", "g", "start", "end"])

    with_places = docs.join(listed, ["doc_id", "mark"]).select("doc_id", "mark", "text", "places")
    found = keep(bounded(with_places).mapInArrow(extend, "doc_id long, mark long, h long, g long, start long, end long"), "found")
    left_open = found.where("h IS NOT NULL")
    open_hashes = keep(left_open.select("h").distinct(), "open")

    def settle(part: pa.RecordBatch, open_ones: Slice) -> list[np.ndarray]:
        texts = Texts(part, window)
        row, position, h = texts.windows(window)
        hit = open_ones.might_hold(h)
        row, position, h = row[hit], position[hit], h[hit]
        return [h, texts.second(row, position, window), texts.doc_id[row]]

    low = lambda met: met.groupBy("h", "g").agg(F.min("doc_id").alias("low"))
    starts = _probed(docs, "h long, g long, doc_id long", settle, filter_slices(open_hashes, filter_bytes), keep, low)
    closed = left_open.join(starts, ["h", "g"]).where("doc_id > low")
    columns = ["doc_id", "mark", F.struct("start", "end").alias("i")]
    every = found.where("h IS NULL").select(*columns).union(closed.select(*columns))
    return every.groupBy("doc_id", "mark").agg(_merged(F.array_sort(F.collect_set("i"))).alias("intervals"))


def _merged(intervals: Column) -> Column:
    """Sorted intervals with those that touch made one."""

    def add(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(intervals, F.array().cast("array<struct<start:bigint,end:bigint>>"), add)


def remove_repeats(docs: DataFrame, window: int = WINDOW, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (the words that
    stay, joined by single spaces).

    Windows are judged on the input.  Null text has no words.  Rows with a null doc_id are returned
    whole and take nothing from others; rows with the same doc_id take nothing from each other.
    Repeated rows come back as often as they came; other columns are not read; an empty table gives
    an empty result.
    """
    mark = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 33).alias("mark")
    marked = docs.select("doc_id", mark, "text")
    with scratch(docs.sparkSession) as keep:
        repeats = repeated_words(marked.where("doc_id IS NOT NULL AND text IS NOT NULL"), keep, window, filter_bytes)
        found = _side(repeats, "size(intervals) * 16")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                array, ends = utf8_parts(part.column("text"))
                data = array.tobytes()
                kept, counts, removed = [], [], []
                bounds, lists = ends.tolist(), part.column("intervals")
                for r in range(part.num_rows):
                    own = data[bounds[r] : bounds[r + 1]].split()
                    counts.append(len(own))
                    if lists[r].is_valid:
                        gone = np.zeros(len(own) + 1, np.int64)
                        for i in lists[r].as_py():
                            gone[i["start"]] += 1
                            gone[i["end"]] -= 1
                        stay = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                        own = [own[k] for k in stay.tolist()]
                    removed.append(counts[-1] - len(own))
                    kept.append(b" ".join(own))
                columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    joined = marked.join(found, ["doc_id", "mark"], "left").select("doc_id", "text", "intervals")
    return bounded(joined).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
