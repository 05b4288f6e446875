"""Bounds of what is held at once between the JVM and Python."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Of an Arrow batch, and of the texts that are Python objects at one time.
BATCH_BYTES, BATCH_ROWS, PIECE_CHARS = 8 << 20, 1000, 1 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with its session's Arrow batches bounded where they were larger."""
    conf = df.sparkSession.conf
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"([1-9]\d*)b?", str(conf.get(key)).lower())
        if not now or int(now[1]) > most:
            conf.set(key, str(most))
    return df


def mapped(batches: Iterator[pa.Array], f: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """``f`` of every text of ``batches``, a piece of bounded texts, one at least, at a time; freed
    memory goes back to the system at the end, as a worker lives on between tasks."""
    for batch in batches:
        found, chars = [], 0
        for text in batch:
            value = text.as_py()
            found.append(f(value))
            chars += len(value or "")
            if chars >= PIECE_CHARS:
                yield pa.array(found, kind)
                found, chars = [], 0
        if found:
            yield pa.array(found, kind)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
