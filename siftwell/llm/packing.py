"""Packing of token ids into fixed-length sequences by minimum bin slack.

Each task packs its own partition in windows of bounded size, without a shuffle.  Documents longer
than a sequence give full sequences first.  Of the remaining lengths, a multiset of 1 to capacity - 1,
the longest is fixed and a bitset subset-sum dynamic programme (bit s of an integer: sum s can be
reached) finds the multiset of others that fills the sequence closest to capacity; the kept steps
are backtracked into counts by length, and the pattern is used as often as its counts allow.  Slack
that no multiset fills is closed by cutting the longest piece left, so sequences are full.  Less
than one sequence remains at a task's end; it is cut into power-of-two sequences, which need no
padding either.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.arrowtext import bounded, give_back, slices
from siftwell.llm.tokenids import CACHE_CHUNKS, default_path, encoder

CAPACITY = 2048
END_ID = 1
#: Tokens that a task holds before it packs them.
WINDOW_TOKENS = 4 << 20

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"


def best_fill(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts by length whose sum is the largest not above ``capacity``; ``lengths`` ascending.

    Longer lengths come first, and the programme stops once the capacity itself is reached."""
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for i in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length, left, take = lengths[i], min(counts[lengths[i]], capacity // lengths[i]), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & full
            left -= take
            take *= 2
        if reach >> capacity:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


class Packer:
    """Packs documents given by ``add``; ``pack`` yields rows (doc, start, length, sequence, offset,
    sequence length), where ``doc`` is what was added."""

    def __init__(self, capacity: int = CAPACITY, most_waiting: int = WINDOW_TOKENS // 4):
        self.capacity, self.most_waiting = capacity, most_waiting
        self.open: dict[int, list[tuple[object, int]]] = {}
        self.tokens = 0
        self.sequences = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple[object, int, int]]) -> None:
        offset, total = 0, sum(p[2] for p in pieces)
        for doc, start, length in pieces:
            self.rows.append((doc, start, length, self.sequences, offset, total))
            offset += length
        self.sequences += 1

    def add(self, doc: object, tokens: int, rest: object = None) -> None:
        """Add a document; ``rest``, if given, stands for it where its last, partial sequence does,
        so that a long document need not be held while that waits."""
        whole = tokens - tokens % self.capacity
        for start in range(0, whole, self.capacity):
            self._emit([(doc, start, self.capacity)])
        if tokens > whole:
            self._put(doc if rest is None else rest, whole, tokens - whole)

    def _put(self, doc: object, start: int, length: int) -> None:
        self.open.setdefault(length, []).append((doc, start))
        self.tokens += length

    def _take(self, length: int) -> tuple[object, int, int]:
        doc, start = self.open[length].pop()
        if not self.open[length]:
            del self.open[length]
        self.tokens -= length
        return doc, start, length

    def _cut(self, length: int) -> tuple[object, int, int]:
        """A piece of exactly ``length`` from the longest left."""
        doc, start, whole = self._take(max(self.open))
        if whole > length:
            self._put(doc, start + length, whole - length)
        return doc, start, min(length, whole)

    def _fill(self, last: bool) -> bool:
        """One pattern; False if no more full sequences can be made."""
        longest = max(self.open)
        counts = {length: len(rows) for length, rows in self.open.items()}
        counts[longest] -= 1
        used = best_fill(sorted(self.open), counts, self.capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        slack = self.capacity - sum(k * n for k, n in used.items())
        if slack and not last:
            return False
        for _ in range(1 if slack else min(len(self.open[k]) // n for k, n in used.items())):
            pieces = [self._take(k) for k, n in used.items() for _ in range(n)]
            room = slack
            while room:
                pieces.append(self._cut(room))
                room -= pieces[-1][2]
            self._emit(pieces)
        return True

    def pack(self, last: bool) -> list[tuple]:
        """Rows ready so far; pieces that leave slack wait for more documents, unless ``last`` or
        while more than ``most_waiting`` tokens wait."""
        while self.tokens >= self.capacity and self._fill(last or self.tokens > self.most_waiting):
            pass
        if last:
            for bit in reversed(range(self.capacity.bit_length())):
                room, pieces = (1 << bit) & self.tokens, []
                while room:
                    pieces.append(self._cut(room))
                    room -= pieces[-1][2]
                if pieces:
                    self._emit(pieces)
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple], base: int) -> pa.RecordBatch:
    """Rows of ``Packer.pack`` over docs (doc_id, id bytes, ids before these, all ids) as output."""
    ids = [d[1][4 * (s - d[2]) : 4 * (s + n - d[2])] for d, s, n, *_ in rows]
    columns = [[d[0] for d, *_ in rows], [r[1] for r in rows], [r[2] for r in rows], ids, [d[3] for d, *_ in rows]]
    columns += [[base + r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows]]
    kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def pack(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY, end_id: int = END_ID, window_tokens: int = WINDOW_TOKENS, cache_chunks: int = CACHE_CHUNKS) -> DataFrame:
    """Pieces of all of ``docs`` (doc_id, text): doc_id, start (the document's ids before it),
    length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset there, and
    sequence_length (``capacity``, or a power of two for a task's last few).

    A document's ids are those of ``vocabulary`` without special tokens and then ``end_id``; null
    text counts as empty.  Null doc_ids and repeated rows are packed like others, other columns are
    not read, an empty table gives no pieces.  A retried task gives the same pieces.  A worker keeps
    the ids of about ``cache_chunks`` chunks of text (some 200 bytes each), which only saves time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what other stages of the worker left
        tokens_of, packer, held = encoder(vocabulary, cache_chunks), Packer(capacity), 0
        base = TaskContext.get().partitionId() << 40
        end = end_id.to_bytes(4, "little")

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            rows = packer.pack(last)
            for i in range(0, len(rows), 4096):
                yield _batch(rows[i : i + 4096], base)

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokens_of.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    whole = n - n % capacity
                    packer.add((doc_id, ids, 0, n), n, (doc_id, ids[4 * whole :], whole, n) if whole else None)
                    held += n
                if held >= window_tokens:
                    yield from flush(False)
                    held = 0
        yield from flush(True)

    return bounded(docs.select("doc_id", "text")).mapInArrow(run, PIECES)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = pack(docs, default_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
