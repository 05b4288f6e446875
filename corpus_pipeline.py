"""The corpus pipeline: five stages over ``documents``, each fed what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  ``run`` writes each stage as Parquet on shared storage and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import decontaminate, packing, quality, secrets, simhash
from siftwell.llm.storage import written
from siftwell.llm.tokenids import default_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule policy keeps."""
    return quality.keep_good(docs, quality.QUERY_POLICY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates by SimHash, the document with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of ``benchmark``."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark."""
    return secrets.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id pieces of all documents in sequences of 2048."""
    # fewer chunks are kept than by the operator alone, beside what earlier stages hold in memory
    return packing.pack(docs, default_path("byte_bpe_50k.json"), cache_chunks=1 << 19)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("packing", sequence_packing),
]

#: Fingerprints, alignments and token ids have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; the packed pieces of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
