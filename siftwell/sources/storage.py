"""Tables that a plan keeps on storage shared by driver and executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  A local session that leaves it unset (tests,
    one machine) gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="siftwell-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name (not yet made) below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` as a Parquet table on shared storage, in folders by the columns ``by``."""
    path = fresh_dir(df.sparkSession, kind)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
