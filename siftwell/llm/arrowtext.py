"""Zero-copy access to the strings of Arrow batches as UTF-8 bytes."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


#: Bounds of an Arrow batch between the JVM and Python, so that long texts do not add up in memory.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches bounded where they were larger."""
    conf = df.sparkSession.conf
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"([1-9]\d*)b?", str(conf.get(key)).lower())
        if not now or int(now[1]) > most:
            conf.set(key, str(most))
    return df


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uint8 data, int64 offsets of n + 1) of a string or binary array; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
        if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
            column = column.cast(pa.string())
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def utf8_values(column: pa.Array) -> Iterator[bytes]:
    """Each value's bytes; null gives empty bytes."""
    data, ends = utf8_parts(column)
    whole, ends = data.tobytes(), ends.tolist()
    for start, end in zip(ends, ends[1:]):
        yield whole[start:end]


def slices(batch: pa.RecordBatch, text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into row ranges of about ``max_bytes`` of text, one row at least."""
    _, ends = utf8_parts(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + max_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def give_back() -> None:
    """Returns freed memory to the system, as a worker lives on between tasks: that of Arrow's pool,
    and of the C library's heap where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
