"""Secret scans: keyword prefilter, anchored expressions near hits, embedded checksums.

One Aho-Corasick pass over each Arrow slice finds all keywords of all its texts.  The regular
expressions are anchored: they run only at keyword hits, in ascending order and past the end of the
kind's last match, which equals a leftmost non-overlapping search.  Long hex runs have no keyword;
a run of 16 covers four neighbouring multiples of four, so only every fourth byte is looked at
before a run is measured.  Token formats that embed a CRC-32 (``github``, ``npm``) are kept only if
it is right.

Everything works on UTF-8 bytes; offsets are turned into code points for texts with hits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.arrowtext import bounded, slices, utf8_parts

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
#: Keywords by kind, lower-cased.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 12, 18, 16
IS_HEX = np.zeros(256, bool)
IS_HEX[list(b"0123456789abcdef")] = True

SPANS = "array<struct<kind:string,start:long,end:long>>"


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def checksum_holds(body: bytes) -> bool:
    """Whether the last six characters are the CRC-32 of the others in base 62."""
    value, digits = zlib.crc32(body[:-6]), bytearray()
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return bytes(reversed(digits)) == body[-6:]


def _match(kind: str, data: bytes, at: int, end: int) -> tuple[int, bool] | None:
    """(end of the match at ``at``, whether it is long and right enough to keep)."""
    if kind == "assign":
        m = ASSIGN.match(data, at, end)
        return m and (m.end(), m.end(1) - m.start(1) >= MIN_ASSIGNED)
    if kind == "access":
        m = ACCESS.match(data, at, end)
        return m and (m.end(), m.end() - at >= MIN_ACCESS)
    m = (GITHUB if kind == "github" else NPM).match(data, at, end)
    return m and (m.end(), checksum_holds(m[1]))


def hex_runs(array: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of each maximal hex run of at least 16 bytes, in order."""
    some = IS_HEX[array[::4]]
    if len(some) < 4:
        return
    last = 0
    for k in np.flatnonzero(some[:-3] & some[1:-2] & some[2:-1] & some[3:]).tolist():
        start = 4 * k
        if start < last or not IS_HEX[array[start : start + 13]].all():
            continue
        while start > last and IS_HEX[array[start - 1]]:
            start -= 1
        stop, step = 4 * k + 13, 64
        while stop < len(array):
            part = IS_HEX[array[stop : stop + step]]
            if not part.all():
                stop += int(part.argmin())
                break
            stop, step = min(stop + step, len(array)), step * 2
        last = stop
        row = int(np.searchsorted(ends, start, side="right")) - 1
        while start < stop:  # texts lie side by side in the buffer
            edge = min(stop, int(ends[row + 1]))
            if edge - start >= MIN_HEX:
                yield row, start, edge
            start, row = max(start, edge), row + 1


def scan_buffer(array: np.ndarray, ends: np.ndarray, words: ahocorasick.Automaton) -> dict[int, list[tuple[int, int, int]]]:
    """By row: (start, kind number, end) in bytes from the row's start, sorted."""
    data = array.tobytes()
    found: dict[int, list[tuple[int, int, int]]] = {}
    done: dict[tuple[int, str], int] = {}
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in words.iter(data.lower().decode("latin-1")))
    rows = (np.searchsorted(ends, np.array([at for at, _ in hits], np.int64), side="right") - 1).tolist() if hits else []
    for (at, kind), row in zip(hits, rows):
        if at < done.get((row, kind), 0):
            continue
        if m := _match(kind, data, at, int(ends[row + 1])):
            done[row, kind] = m[0]
            if m[1]:
                found.setdefault(row, []).append((at, KINDS.index(kind), m[0]))
    for row, start, stop in hex_runs(array, ends):
        found.setdefault(row, []).append((start, KINDS.index("hex"), stop))
    return {row: sorted((s - int(ends[row]), k, e - int(ends[row])) for s, k, e in spans) for row, spans in found.items()}


def _spans(batch: pa.RecordBatch, words: ahocorasick.Automaton) -> tuple[list[int], list[str], list[int], list[int]]:
    """List offsets, kinds, starts and ends (code points) of a batch's spans."""
    array, ends = utf8_parts(batch.column("text"))
    found = scan_buffer(array, ends, words)
    counts = np.zeros(batch.num_rows + 1, np.int64)
    kinds, starts, stops = [], [], []
    for row in sorted(found):
        own = array[ends[row] : ends[row + 1]]
        points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        counts[row + 1] = len(found[row])
        for s, k, e in found[row]:
            kinds.append(KINDS[k])
            starts.append(int(points[s]))
            stops.append(int(points[e]))
    return np.cumsum(counts).tolist(), kinds, starts, stops


def scan(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` that are named here (doc_id, text) reduced to doc_id and ``spans``:
    one row per row, spans sorted by start and then kind, offsets in code points, end exclusive.

    Null text counts as empty and has no spans.  Null doc_ids and repeated rows are kept; other
    columns are not read; an empty table gives an empty result.  Texts of any length are scanned
    whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, kinds, starts, stops = _spans(part, words)
                items = pa.StructArray.from_arrays(
                    [pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], names=["kind", "start", "end"]
                )
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "spans"])

    return bounded(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark`` (overlapping spans together), and
    ``n_chars`` counted anew where the text changed.  Other columns and null texts stay as they are."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            for part in slices(batch, "text"):
                array, ends = utf8_parts(part.column("text"))
                found = scan_buffer(array, ends, words)
                if found:
                    texts = part.column("text").to_pylist()
                    changed = {}
                    for row, spans in found.items():
                        own, pieces, last = array[ends[row] : ends[row + 1]].tobytes(), [], 0
                        for s, _, e in spans:
                            if s >= last:
                                pieces += [own[last:s], mark.encode()]
                            last = max(last, e)
                        texts[row] = changed[row] = b"".join([*pieces, own[last:]]).decode()
                    columns = list(part.columns)
                    columns[names.index("text")] = pa.array(texts, part.column("text").type)
                    if "n_chars" in names:
                        counts = part.column("n_chars").to_pylist()
                        for row, text in changed.items():
                            counts[row] = len(text)
                        columns[names.index("n_chars")] = pa.array(counts, part.column("n_chars").type)
                    part = pa.RecordBatch.from_arrays(columns, names=names)
                yield part

    return bounded(docs).mapInArrow(run, schema)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
