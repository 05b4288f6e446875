"""Token-id files: static range asymmetric numeral system over interleaved blocks.

Documents are put in ascending doc_id order by range partitioning; each task streams its range into
files of bounded size.  A file holds

    MAGIC | JSON header length (u4) | JSON header | frequency table | document table | blocks

Its one frequency table (static, counted over all ids of the file, scaled to ``1 << SCALE_BITS``)
is shared by all blocks.  A block codes up to ``block_tokens`` ids and is decodable by itself: ids
are dealt over interleaved lanes, each with its own rANS state, coded together as numpy vectors;
lanes that overflow append 32-bit words to one common stream.  The header's checkpoints list each
block's byte offset, first id and lane count, so blocks decode in parallel; CRC-32s cover each
block's bytes, its decoded ids, both tables and the header.  The document table holds doc_ids and
lengths.

Files are written under a temporary name and then moved, so a retried task leaves the same files.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.arrowtext import bounded, slices
from siftwell.llm.storage import filesystem, fresh_dir, written
from siftwell.llm.tokenids import default_path, encoder

MAGIC = b"SWRANS01"
SCALE_BITS = 18
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
END_ID = 1
LANES = 8192
BLOCK_TOKENS = 2 << 20
FILE_TOKENS = 4 << 20
#: Characters of a text that tell ranges of one doc_id apart; blocks that a reading task should have.
RANGE_CHARS, TASK_BLOCKS = 64, 16
MANIFEST = "path string, part long, number long, docs long, tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"


class CorruptFile(ValueError):
    """A token file whose checksums or structure do not hold."""


# -- frequency tables -----------------------------------------------------------------------------


def scaled_frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to ``1 << SCALE_BITS`` with every present symbol at 1 or more."""
    total, present = int(counts.sum()), counts > 0
    size = 1 << SCALE_BITS
    if int(present.sum()) > size:
        raise ValueError("more distinct ids than the table has room for")
    scaled = np.where(present, np.maximum(1, counts.astype(np.float64) * size / max(1, total)), 0).astype(np.int64)
    excess = int(scaled.sum()) - size
    while excess > 0:  # the rounding up of rare symbols is taken from the common ones
        for i in np.argsort(-scaled, kind="stable").tolist():
            step = min(excess, int(scaled[i]) // 2)
            scaled[i] -= step
            excess -= step
            if not excess or not step:
                break
    scaled[int(scaled.argmax())] -= excess
    return scaled


@dataclass
class Table:
    """Frequencies and cumulated frequencies by symbol number, and the ids of the numbers."""

    ids: np.ndarray
    freq: np.ndarray

    def __post_init__(self) -> None:
        self.freq = self.freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.gap = np.uint64(1 << SCALE_BITS) - self.freq
        self.most = self.freq << np.uint64(63 - SCALE_BITS)

    def slots(self) -> np.ndarray:
        """Symbol number of each of the ``1 << SCALE_BITS`` slots."""
        return np.repeat(np.arange(len(self.ids), dtype=np.uint32), self.freq.astype(np.int64))


# -- blocks ---------------------------------------------------------------------------------------


def encode_block(numbers: np.ndarray, table: Table, lanes: int) -> bytes:
    """rANS bytes of symbol numbers: the lanes' final states, then the words in decoding order."""
    lanes = max(1, min(lanes, len(numbers)))
    rows = -(-len(numbers) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    for r in range(rows - 1, -1, -1):
        some = numbers[r * lanes : (r + 1) * lanes]
        x = state[: len(some)]  # a view: the lanes' states change in place
        over = np.flatnonzero(x >= table.most[some])
        spilled = x[over]
        words.append(spilled.astype(np.uint32))
        x[over] = spilled >> WORD
        q = x // table.freq[some]
        q *= table.gap[some]
        x += q  # x becomes (x // f << SCALE_BITS) + x % f + c
        x += table.cum[some]
    return state.astype("<u8").tobytes() + b"".join(w.astype("<u4").tobytes() for w in reversed(words))


def decode_block(data: bytes, count: int, table: Table, slots: np.ndarray, lanes: int) -> np.ndarray:
    """Symbol numbers of a block's bytes."""
    lanes = max(1, min(lanes, count))
    if len(data) < 8 * lanes:
        raise CorruptFile("a block is too short")
    state = np.frombuffer(data, "<u8", lanes).astype(np.uint64)
    words = np.frombuffer(data, "<u4", (len(data) - 8 * lanes) // 4, 8 * lanes).astype(np.uint64)
    out = np.empty(count, np.uint32)
    low, scale, at = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), 0
    for r in range(0, count, lanes):
        n = min(lanes, count - r)
        x = state[:n]
        slot = x & low
        symbol = slots[slot]
        out[r : r + n] = symbol
        x = table.freq[symbol] * (x >> scale) + slot - table.cum[symbol]
        under = np.flatnonzero(x < LOW)
        if at + len(under) > len(words):
            raise CorruptFile("a block's words end early")
        x[under] = (x[under] << WORD) | words[at : at + len(under)]
        at += len(under)
        state[:n] = x
    if at != len(words) or (state != LOW).any():
        raise CorruptFile("a block's states do not close")
    return out


# -- files ----------------------------------------------------------------------------------------


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, *, lanes: int = LANES, block_tokens: int = BLOCK_TOKENS) -> bytes:
    """A whole file of documents whose ids lie side by side in ``ids``."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    present = np.flatnonzero(counts)
    table = Table(present.astype(np.uint32), scaled_frequencies(counts[present]) if len(present) else present)
    number_of = np.zeros(len(counts), np.uint32)
    number_of[present] = np.arange(len(present), dtype=np.uint32)
    frequencies = zlib.compress(np.stack([present, table.freq.astype(np.int64)]).astype("<u4").tobytes(), 1)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    values = np.array([d or 0 for d in doc_ids], "<i8")
    documents = zlib.compress(known.tobytes() + values.tobytes() + np.array(lengths, "<i8").tobytes(), 1)
    blocks, checkpoints, offset = [], [], 0
    for first in range(0, len(ids), block_tokens):
        some = ids[first : first + block_tokens]
        own = max(1, min(lanes, len(some) // 256))
        data = encode_block(number_of[some], table, own)
        checkpoints.append([offset, len(data), first, len(some), own, zlib.crc32(data), zlib.crc32(some.astype("<u4").tobytes())])
        blocks.append(data)
        offset += len(data)
    header = {"docs": len(lengths), "tokens": len(ids), "scale_bits": SCALE_BITS, "symbols": len(present), "checkpoints": checkpoints}
    header |= {"frequencies": [len(frequencies), zlib.crc32(frequencies)], "documents": [len(documents), zlib.crc32(documents)]}
    text = json.dumps(header).encode()
    return b"".join([MAGIC, len(text).to_bytes(4, "little"), zlib.crc32(text).to_bytes(4, "little"), text, frequencies, documents, *blocks])


class TokenFile:
    """Reads a file from a seekable binary stream: documents, and ids block by block."""

    def __init__(self, stream):
        self.stream = stream
        start = self._read(16)
        if start[:8] != MAGIC:
            raise CorruptFile("not a token file")
        text = self._read(int.from_bytes(start[8:12], "little"))
        if zlib.crc32(text) != int.from_bytes(start[12:], "little"):
            raise CorruptFile("the header's checksum differs")
        self.header = json.loads(text)
        if self.header["scale_bits"] != SCALE_BITS:
            raise CorruptFile("another scale")
        table = np.frombuffer(self._part("frequencies"), "<u4").reshape(2, self.header["symbols"])
        self.table = Table(table[0].copy(), table[1].copy())
        self.slots = self.table.slots()
        documents, n = self._part("documents"), self.header["docs"]
        known = np.frombuffer(documents, np.uint8, n)
        values = np.frombuffer(documents, "<i8", n, n).tolist()
        self.doc_ids = [v if k else None for k, v in zip(known, values)]
        self.lengths = np.frombuffer(documents, "<i8", n, 9 * n)
        self.blocks_at = self.stream.tell()

    def _read(self, n: int) -> bytes:
        data = self.stream.read(n)
        if len(data) != n:
            raise CorruptFile("the file ends early")
        return data

    def _part(self, name: str) -> bytes:
        n, crc = self.header[name]
        data = self._read(n)
        if zlib.crc32(data) != crc:
            raise CorruptFile(f"the checksum of {name} differs")
        return zlib.decompress(data)

    def block(self, k: int) -> np.ndarray:
        """The ids of block ``k`` alone."""
        offset, size, _, count, lanes, crc, ids_crc = self.header["checkpoints"][k]
        self.stream.seek(self.blocks_at + offset)
        data = self._read(size)
        if zlib.crc32(data) != crc:
            raise CorruptFile(f"the checksum of block {k} differs")
        ids = self.table.ids[decode_block(data, count, self.table, self.slots, lanes)]
        if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise CorruptFile(f"the ids of block {k} differ")
        return ids

    def documents(self, of: int | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, its ids as bytes), holding little over a block and a
        document; with ``of`` only documents that start in that block, which decodes from there."""
        firsts = [c[2] for c in self.header["checkpoints"]] or [0]
        starts = np.cumsum(self.lengths) - self.lengths
        low = 0 if not of else int(np.searchsorted(starts, firsts[of]))
        high = len(starts) if of is None or of + 1 >= len(firsts) else int(np.searchsorted(starts, firsts[of + 1]))
        held, at, k = memoryview(b""), 0, of or 0
        if low < high and starts[low] > firsts[k]:  # the block opens inside a document
            held, at, k = memoryview(self.block(k).astype("<u4").tobytes()), 4 * int(starts[low] - firsts[k]), k + 1
        for doc_id, start, length in zip(self.doc_ids[low:high], starts[low:high].tolist(), self.lengths[low:high].tolist()):
            parts: list[bytes] = []
            have = len(held) - at
            while have < 4 * length:
                parts.append(self.block(k).astype("<u4").tobytes())
                have += len(parts[-1])
                k += 1
            if parts:
                held, at = memoryview(b"".join([held[at:], *parts])), 0
            yield doc_id, start, bytes(held[at : at + 4 * length])
            at += 4 * length


# -- Spark ----------------------------------------------------------------------------------------


def write_ids(docs: DataFrame, folder: str, vocabulary: str, *, end_id: int = END_ID, file_tokens: int = FILE_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order (null first, ties by text) as files
    in ``folder``; returns the table (path, before, blocks) of files, ids before each, and its blocks.

    Each document gets its ids without special tokens and then ``end_id``; null text is empty.
    Repeated rows are written as often as they come; other columns are not read; an empty table
    writes no file.  Rows of one doc_id may be parted by the beginnings of their texts.  Nothing of
    the files comes to the driver: their table is kept on shared storage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens_of = encoder(vocabulary)
        part, end = TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        doc_ids: list[int | None] = []
        pieces: list[bytes] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{number:06d}.rans"
            lengths, ids = [len(p) // 4 for p in pieces], np.frombuffer(b"".join(pieces), "<u4")
            pieces.clear()
            _write(path, encode_file(doc_ids, lengths, ids, block_tokens=block_tokens))
            row = ([path], [part], [number], [len(lengths)], [held])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["path", "part", "number", "docs", "tokens"])

        for batch in batches:
            for some in slices(batch, "text", 2 << 20):
                texts = [t or "" for t in some.column("text").to_pylist()]
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), tokens_of.encode(texts)):
                    doc_ids.append(doc_id)
                    pieces.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= file_tokens:
                        yield flush()
                        doc_ids, pieces, held, number = [], [], 0, number + 1
        if pieces:
            yield flush()

    start = F.substring("text", 1, RANGE_CHARS)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", start).sortWithinPartitions("doc_id", "text")
    manifest = written(bounded(ordered).mapInArrow(run, MANIFEST), "token-files")
    # ids before a part: one row for each task that wrote; before a file: within its part
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier(Window.orderBy("part"), "n").alias("base"))
    files = manifest.join(parts, "part").withColumn("before", F.col("base") + earlier(Window.partitionBy("part").orderBy("number"), "tokens"))
    return files.select("path", "before", F.ceil(F.col("tokens") / block_tokens).cast("int").alias("blocks"))


def _write(path: str, data: bytes) -> None:
    """Write under a temporary name, then move."""
    files, place = filesystem(path)
    folder, _, name = place.rpartition("/")
    files.create_dir(folder, recursive=True)
    temporary = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, place)


def read_ids(spark, files: DataFrame) -> DataFrame:
    """Documents of token files: doc_id, start (ids of all documents before it), n_tokens, ids
    (little-endian unsigned 32-bit).  ``files`` is a table as from ``write_ids``.  Blocks are dealt to
    tasks, some neighbouring ones to each, which find them by the checkpoints; a block gives the
    documents that start in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream, file = None, None, None
        for batch in batches:
            for path, before, block in zip(*(batch.column(c).to_pylist() for c in ("path", "before", "block"))):
                if path != opened:
                    if stream:
                        stream.close()
                    system, place = filesystem(path)
                    stream = system.open_input_file(place)
                    opened, file = path, TokenFile(stream)
                rows: list[tuple[int | None, int, bytes]] = []
                size = 0
                for doc_id, start, ids in file.documents(block):
                    rows.append((doc_id, before + start, ids))
                    size += len(ids)
                    if size >= 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                if rows:
                    yield _rows(rows)
        if stream:
            stream.close()

    blocks = files.select("path", "before", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    total = files.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    tasks = min(total, max(8 * spark.sparkContext.defaultParallelism, -(-total // TASK_BLOCKS)))
    return blocks.repartitionByRange(max(1, tasks), "before", "block").sortWithinPartitions("before", "block").mapInArrow(run, ROWS)


def _rows(rows: list[tuple[int | None, int, bytes]]) -> pa.RecordBatch:
    columns = [[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) // 4 for r in rows]]
    arrays = [*(pa.array(c, pa.int64()) for c in columns), pa.array([r[2] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids"])


def op7_token_file(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_ids(docs, fresh_dir(spark, "tokens"), default_path("word_bpe_49k.json"))
    return read_ids(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
