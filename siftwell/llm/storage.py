"""Shared storage for lineage cuts and for the files operators write.

Everything durable goes under the folder named by ``spark.checkpoint.dir``, which driver and
executors share.  Only when a local session leaves it unset (tests, one machine) is a temporary
folder made; on a cluster that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name (not yet made) below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` on shared storage, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table on shared storage, or in ``folder``: for large rows that are read
    several times, as it is compressed and its columns are read apart."""
    path = f"{folder}/{kind}-{uuid.uuid4().hex}" if folder else fresh_dir(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A function that materialises a table as ``written`` does, in a folder that goes at the end."""
    folder = fresh_dir(spark, "scratch")
    try:
        yield lambda df, kind="table": written(df, kind, folder)
    finally:
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works on driver and executors alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
