"""WARC archives: a writer with revisit records, and a salvage reader.

Writing.  Each record is one gzip member.  Payloads are digested in the JVM; payloads of at least
``min_revisit`` bytes that occur more than once keep one response, the others become revisit
records, which hold the HTTP head alone and name the response they repeat.  Tasks stream records
into files of bounded size, under a temporary name that is moved at the end, so a retried task
leaves the same files.

Reading.  A record counts only if its gzip member, lengths, block digest and (for responses) payload
digest hold.  After a failed check the reader searches for the next gzip member that opens with a
version line, or the next plain version line, goes on from there, and logs the bytes between as a
quarantined gap.  Files are read through a window, never as a whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.arrowtext import bounded, slices, utf8_values
from siftwell.llm.storage import cut, filesystem, fresh_dir

VERSION = b"WARC/1.1"
MEMBER = b"\x1f\x8b\x08"
MARKERS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
URN = "urn:siftwell:page:"
DATE = "2024-01-01T00:00:00Z"
STEP = 1 << 18
#: Longest record that the reader accepts, header included; longer than any that a row can fill.
MAX_RECORD = 1 << 32

READ = (
    "file string, at long, size long, inside long, inside_size long, reason string, record_type string, record_id string, target_uri string, "
    "refers_to string, payload_digest string, payload_bytes long, payload binary"
)


# -- records --------------------------------------------------------------------------------------


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A response record of ``payload``, or with ``refers_to`` a revisit record without it."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """``data`` as one gzip member; the same data gives the same bytes."""
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    return coder.compress(data) + coder.flush()


# -- salvage reader -------------------------------------------------------------------------------


class Damaged(ValueError):
    """A record that fails a check."""


@dataclass
class Record:
    at: int
    size: int
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int = 0


@dataclass
class Gap:
    """Bytes ``at`` a place of the file that hold no record; or, with ``inside``, a place in what the
    member there inflates to, ``inside_size`` bytes long (0 where the rest is unknown)."""

    at: int
    size: int
    reason: str
    inside: int | None = None
    inside_size: int | None = None


@dataclass
class Window:
    """Random access to a seekable stream through one buffer."""

    stream: object
    length: int
    start: int = 0
    data: bytes = field(default=b"")

    def get(self, at: int, n: int) -> bytes:
        if not self.start <= at or at + n > self.start + len(self.data):
            self.stream.seek(at)
            self.start, self.data = at, self.stream.read(max(n, STEP))
        return self.data[at - self.start : at - self.start + n]


def parse_head(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header line has no colon")
        headers[name.strip().lower()] = value.strip()
    return headers


def parse_record(read, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at ``at``; ``read(at, n)`` gives bytes."""
    head = read(at, 10)
    if not re.match(rb"WARC/1\.[01]\r\n", head):
        raise Damaged("no version line")
    size = 4096
    while (stop := (head := read(at, size)).find(b"\r\n\r\n")) < 0:
        if len(head) < size or size >= MAX_RECORD:
            raise Damaged("the header does not end")
        size *= 4
    headers = parse_head(head[:stop])
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        raise Damaged("a mandatory header is missing")
    length = headers.get("content-length", "")
    if not length.isdigit() or int(length) > MAX_RECORD:
        raise Damaged("no valid content length")
    start, n = at + stop + 4, int(length)
    block = read(start, n + 4)
    if len(block) != n + 4 or block[n:] != b"\r\n\r\n":
        raise Damaged("the block does not end where it should")
    return headers, block[:n], start + n + 4


def verify(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int]:
    """(payload, its full length) once the digests hold; a revisit has no payload."""
    kind, digest = headers.get("warc-type"), headers.get("warc-block-digest")
    if digest and digest.lower().removeprefix("sha256:") != hashlib.sha256(block).hexdigest():
        raise Damaged("the block digest differs")
    http, mark, payload = block.partition(b"\r\n\r\n")
    if kind not in ("response", "revisit") or not mark:
        return block, len(block)
    if kind == "revisit":
        found = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.MULTILINE)
        return None, int(found[1]) if found else 0
    digest = headers.get("warc-payload-digest")
    if digest and digest.lower().startswith("sha256:") and digest.lower()[7:] != hashlib.sha256(payload).hexdigest():
        raise Damaged("the payload digest differs")
    return payload, len(payload)


class Inflated:
    """What a gzip member inflates to, read forwards: ``drop`` forgets bytes.  At the end ``end`` is
    where the member ends in the file, or ``error`` what broke it; whatever inflates before is there."""

    def __init__(self, window: Window, at: int):
        self.window, self.at, self.pos = window, at, at
        self.coder, self.tail, self.data, self.base = zlib.decompressobj(31), b"", bytearray(), 0
        self.end: int | None = None
        self.error: str | None = None

    @property
    def total(self) -> int:
        return self.base + len(self.data)

    @property
    def done(self) -> bool:
        return self.end is not None or self.error is not None

    def fill(self, upto: int) -> None:
        while self.total < upto and not self.done:
            piece = self.tail or self.window.get(self.pos, max(0, min(STEP, self.window.length - self.pos)))
            if not piece:
                self.error = "the member is cut off"
                return
            self.pos += 0 if self.tail else len(piece)
            try:
                self.data += self.coder.decompress(piece, 4 * STEP)
            except zlib.error as error:
                self.error = f"the member is broken: {error}"
                self.rescue()
                return
            self.tail = self.coder.unconsumed_tail
            if self.coder.eof:
                self.end = self.pos - len(self.coder.unused_data)

    def rescue(self) -> None:
        """Inflates up to the very byte that breaks the stream, as the piece with it gave nothing."""
        coder, at, seen = zlib.decompressobj(31), self.at, 0
        while True:
            before = coder.copy()
            piece = self.window.get(at, max(0, min(4096, self.window.length - at)))
            try:
                out = coder.decompress(piece)
            except zlib.error:
                break
            self.data += out[max(0, self.total - seen) :]
            seen, at = seen + len(out), at + len(piece)
        for byte in piece:
            try:
                out = before.decompress(bytes([byte]))
            except zlib.error:
                return
            self.data += out[max(0, self.total - seen) :]
            seen += len(out)

    def get(self, at: int, n: int) -> bytes:
        self.fill(at + n)
        return bytes(self.data[at - self.base : at - self.base + n])

    def drop(self, at: int) -> None:
        del self.data[: at - self.base]
        self.base = at

    def finish(self) -> None:
        """Inflates the rest and forgets it."""
        while not self.done:
            self.fill(self.total + STEP)
            self.drop(self.total)


def next_start(window: Window, at: int) -> int:
    """The next position that opens like a record, or the end of the file."""
    while at < window.length:
        piece = window.get(at, min(STEP, window.length - at))
        for found in MARKERS.finditer(piece):
            place = at + found.start()
            if found[0] != MEMBER or Inflated(Window(window.stream, window.length), place).get(0, 7) == b"WARC/1.":
                return place
        if len(piece) == window.length - at:
            break
        at += len(piece) - 10  # a marker may lie across the edge
    return window.length


def next_version(member: Inflated, at: int) -> int:
    """The next version line inside a member, or its end; what is before is forgotten."""
    while piece := member.get(at, STEP):
        if found := re.search(rb"WARC/1\.[01]\r\n", piece):
            return at + found.start()
        if len(piece) < STEP:
            return at + len(piece)
        at += len(piece) - 9
        member.drop(at)
    return at


def member_items(member: Inflated, size: int, broken: str | None) -> Iterator[Record | Gap]:
    """The sound records of a member of ``size`` bytes, and gaps between them; ``broken`` is what is
    wrong with the member itself."""
    pos, bad = 0, None
    while member.get(pos, 1):
        try:
            headers, block, end = parse_record(member.get, pos)
            payload, n = verify(headers, block)
            if broken and not headers.get("warc-block-digest"):
                raise Damaged(f"no block digest, and {broken}")
        except Damaged as error:
            bad = bad or (pos, str(error))
            pos = next_version(member, pos + 1)
            member.drop(min(pos, member.total))
            continue
        if bad:
            yield Gap(member.at, size, bad[1], bad[0], pos - bad[0])
            bad = None
        yield Record(member.at, size, headers, payload, n)
        pos = end
        member.drop(pos)
    if bad or broken:
        place, reason = bad or (member.total, None)
        yield Gap(member.at, size, broken or reason, place, member.total - place)


def items_at(window: Window, at: int) -> tuple[Iterator[Record | Gap], int]:
    """The records, and gaps inside, of the member or plain record at ``at``, and its end.  If no
    record there is sound, ``Damaged``."""
    if window.get(at, 3) != MEMBER:
        headers, block, end = parse_record(lambda a, n: window.get(a, min(n, max(0, window.length - a))), at)
        payload, size = verify(headers, block)
        return iter([Record(at, end - at, headers, payload, size)]), end
    member = Inflated(window, at)
    try:
        headers, block, pos = parse_record(member.get, 0)
        payload, n = verify(headers, block)
        member.fill(pos + 1)
        if member.end is not None and member.total == pos:  # one record, as archives should have it
            return iter([Record(at, member.end - at, headers, payload, n)]), member.end
    except Damaged:
        pass
    member.finish()
    if not member.total:
        raise Damaged(member.error or "an empty member")
    end = member.end if member.end is not None else next_start(window, at + 1)
    ahead, items = [], member_items(Inflated(Window(window.stream, window.length), at), end - at, member.error)
    for x in items:  # one gap at most comes before a record
        ahead.append(x)
        if isinstance(x, Record):
            return chain(ahead, items), end
    raise Damaged(ahead[0].reason)


def salvage(stream, length: int) -> Iterator[Record | Gap]:
    """Every sound record of an archive, and a Gap for every run of bytes between that is not one."""
    window, at, gap = Window(stream, length), 0, None
    while at < length:
        try:
            items, end = items_at(window, at)
        except Damaged as error:
            gap = gap or Gap(at, 0, str(error))
            at = next_start(window, at + 1)  # neighbouring gaps are one
            gap.size = at - gap.at
            continue
        if gap:
            yield gap
            gap = None
        yield from items
        at = end
    if gap:
        yield gap


# -- Spark ----------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_revisit: int = 100, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, html, digest and ``first``: the smallest page_id with the same payload, where
    that is another one and the payload has at least ``min_revisit`` bytes; else null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = pages.select("page_id", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")).where(f"n >= {min_revisit}")
    repeats = cut(large.groupBy("digest").agg(F.min("page_id").alias("low"), F.count("*").alias("n")).where("n > 1 AND low IS NOT NULL").select("digest", "low"))
    if repeats.count() <= broadcast_rows:  # each row is a digest and a long
        repeats = F.broadcast(repeats)
    return rows.join(repeats, "digest", "left").select("page_id", "url", "html", "digest", F.when(F.col("low") != F.col("page_id"), F.col("low")).alias("first"))


def write_archives(pages: DataFrame, folder: str, *, level: int = 3, file_bytes: int = 64 << 20, min_revisit: int = 100) -> list[str]:
    """Write a record per row of ``pages`` (page_id, url, html) into ``*.warc.gz`` files in
    ``folder``; returns their paths.

    Null html is an empty payload, null url has no target URI.  Rows that repeat the smallest
    page_id of a payload are all responses.  A null page_id is written as a response, and never
    referred to, unless the payload also has a numbered page, which it then revisits.  Other columns
    are not read; an empty table writes no file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        part, number, out, size = TaskContext.get().partitionId(), 0, None, 0
        paths: list[str] = []

        def close() -> None:
            nonlocal out, number, size
            out.close()
            name = f"part-{part:06d}-{number:06d}.warc.gz"
            system.move(temporary, f"{base}/{name}")
            paths.append(f"{folder}/{name}")
            out, number, size = None, number + 1, 0

        for batch in batches:
            for some in slices(batch, "html"):
                ids, urls, digests, firsts = (some.column(c).to_pylist() for c in ("page_id", "url", "digest", "first"))
                for page, url, payload, digest, first in zip(ids, urls, utf8_values(some.column("html")), digests, firsts):
                    if out is None:
                        system.create_dir(base, recursive=True)
                        temporary = f"{base}/_{part}.{uuid.uuid4().hex}"
                        out = system.open_output_stream(temporary)
                    refers = None if first is None else f"{URN}{first}"
                    data = member(record_bytes(f"{URN}{'null' if page is None else page}", url, payload, digest, refers), level)
                    out.write(data)
                    size += len(data)
                    if size >= file_bytes:
                        close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return sorted(r.path for r in bounded(with_revisits(pages, min_revisit)).mapInArrow(run, "path string").collect())


def read_archives(spark, paths: list[str], *, with_payload: bool = True) -> DataFrame:
    """Records and gaps of archives, one row each: file, at, size (bytes there), and for a gap its
    ``reason``, with inside and inside_size where it lies inside a member; for a record record_type, record_id, target_uri, refers_to, payload_digest (bare
    hex), payload_bytes (of the full payload, also for a revisit) and, if asked for, payload.

    Records of other types have their block as payload.  No paths give an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = filesystem(path)
                rows, size = [], 0
                with system.open_input_file(place) as stream:
                    for x in salvage(stream, stream.size()):
                        rows.append(_row(path, x, with_payload))
                        size += len(rows[-1][-1] or b"") + 500
                        if size > 4 << 20:
                            yield _table(rows)
                            rows, size = [], 0
                if rows:
                    yield _table(rows)

    files = spark.createDataFrame([(p,) for p in paths], "path string")
    return files.repartition(max(1, len(paths))).mapInArrow(run, READ)


def _bare(value: str | None, prefix: str = "") -> str | None:
    return None if value is None else value.strip("<>").removeprefix(prefix)


def _row(path: str, x: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(x, Gap):
        return (path, x.at, x.size, x.inside, x.inside_size, x.reason, *[None] * 7)
    h = x.headers
    digest = (h.get("warc-payload-digest") or "").lower().removeprefix("sha256:") or None
    names = (h.get("warc-type"), _bare(h.get("warc-record-id")), h.get("warc-target-uri"), _bare(h.get("warc-refers-to")), digest)
    return (path, x.at, x.size, None, None, None, *names, x.payload_bytes, x.payload if with_payload else None)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in READ.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def _page(urn: str):
    return F.expr(f"try_cast(substr({urn}, {len(URN) + 1}) AS bigint)")


def op3_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    paths = write_archives(pages, fresh_dir(spark, "warc"))
    records = read_archives(spark, paths, with_payload=False)
    # a gap in what was just written would be a lost page, so it is an error
    size = F.when(F.col("reason").isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat("file", F.lit(": "), "reason")).cast("long"))
    return records.select(
        _page("record_id").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", _page("refers_to").alias("refers_to")
    )


OP3_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
low AS (SELECT payload_digest, min(page_id) AS low FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN low <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN low <> page_id THEN low END AS refers_to
FROM p LEFT JOIN low USING (payload_digest)
"""
