"""Centroid clustering of integer vectors, exact at every step.

Vectors are packed into blocks, kept as a table on shared storage, so that rounds read bytes and a
lost executor costs a block's work.  Squared distances of a block to all centroids are expanded,
|x|^2 - 2 x.c + |c|^2, so that the products are one matrix product of float64 (BLAS).  All of its
terms and partial sums are integers below dimension * (max|x| + max|c|)^2; rows for which that
stays below 2^53 are exact in float64 in whatever order BLAS adds, others are computed from
differences in 64-bit integers, or in Python's where even these could overflow.

A round combines counts and sums by ``treeAggregate``; they are Python integers, k * dimension of
them, so neither the number of vectors nor their size can make them overflow.  The driver holds
nothing but centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.storage import written

#: Every intermediate value of a row lies below: exact in float64; exact in int64.  Bounds are
#: computed in float64 themselves, hence the margin.
FLOAT_LIMIT, INT_LIMIT = 2.0**53 * (1 - 1e-9), 2.0**63 * (1 - 1e-9)
#: Rows whose differences to the centroids are held at once by the integer paths.
FALLBACK_ROWS = 256


# -- exact distances ------------------------------------------------------------------------------


def scaled_floor(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite floats: float64 where that is exact (whole numbers, or such a
    scale as a power of two), an array of Python integers where the product would leave float64."""
    values = values.astype(np.float64)
    with np.errstate(over="ignore"):
        out = np.floor(values * scale)
    if np.isfinite(out).all():
        return out
    return np.array([[scale * int(x) if abs(x) >= 2.0**53 else int(np.floor(scale * x)) for x in row] for row in values], object)


def as_integers(rows: np.ndarray) -> np.ndarray:
    """An array of Python integers."""
    return rows if rows.dtype == object else np.array([[int(x) for x in row] for row in rows.tolist()], object).reshape(rows.shape)


def reach(rows: np.ndarray) -> np.ndarray:
    """The largest magnitude of each row, as float64 (infinite beyond)."""
    if rows.dtype != object:
        return np.abs(rows).max(axis=1, initial=0.0)
    return np.array([float(m) if (m := max(map(abs, row))) < 1 << 1023 else np.inf for row in rows])


def nearest(rows: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """(number of the nearest centroid of each row, smaller one on ties; squared distances)."""
    number, squares = np.zeros(len(rows), np.int64), [0] * len(rows)
    exact = np.array(centroids, object)
    with np.errstate(over="ignore"):
        bound = rows.shape[1] * (reach(rows) + reach(exact).max()) ** 2
    small, middle = bound < FLOAT_LIMIT, bound < INT_LIMIT
    for mine, kind in ((small, np.float64), (middle & ~small, np.int64), (~middle, object)):
        at = np.flatnonzero(mine)
        if not len(at):
            continue
        if kind is np.float64:
            x, c = rows[at].astype(np.float64), exact.astype(np.float64)
            table = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
            found = table.argmin(axis=1)
            number[at], values = found, table[np.arange(len(at)), found].astype(np.int64).tolist()
        else:
            x, c = (as_integers(rows[at]), exact) if kind is object else (rows[at].astype(np.int64), exact.astype(np.int64))
            values = []
            for part in np.split(np.arange(len(at)), range(FALLBACK_ROWS, len(at), FALLBACK_ROWS)):
                table = ((x[part][:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
                found = table.argmin(axis=1)
                number[at[part]] = found
                values += table[np.arange(len(part)), found].tolist()
        for i, v in zip(at.tolist(), values):
            squares[i] = v
    return number, squares


def exact_sum(rows: np.ndarray) -> list[int]:
    """The component sums of rows, as Python integers."""
    if rows.dtype != object and len(rows) * float(reach(rows).max(initial=0.0)) < FLOAT_LIMIT:
        return [int(x) for x in rows.sum(axis=0).tolist()]
    return as_integers(rows).sum(axis=0).tolist()


# -- blocks ---------------------------------------------------------------------------------------


def whole_vectors(embedding: Column, dimension: int) -> Column:
    """Whether a vector has exactly ``dimension`` components, none null or non-finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return embedding.isNotNull() & (F.size(embedding) == dimension) & F.coalesce(finite, F.lit(False))


def packed(vectors: DataFrame, dimension: int) -> DataFrame:
    """(ids, data) blocks of the whole vectors of ``vectors`` (vec_id, embedding) on shared storage;
    data has the components as float32 or float64 in row order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([values.tobytes()], pa.binary())], names=["ids", "data"])

    kept = vectors.select("vec_id", "embedding").where(whole_vectors(F.col("embedding"), dimension))
    return written(kept.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "ids array<long>, data binary"), "vectors")


# -- clustering -----------------------------------------------------------------------------------


def start_vectors(vectors: DataFrame, k: int, dimension: int, seed: int) -> list[list[float]]:
    """The whole vectors with the k smallest lower-case hex SHA-256 of ``seed:vec_id``, in that order;
    repeated ids in the order of their vectors; rows without an id never start one."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("vec_id").cast("string")), 256)
    named = vectors.where(F.col("vec_id").isNotNull() & whole_vectors(F.col("embedding"), dimension))
    rows = named.select(digest.alias("digest"), "embedding").orderBy("digest", "embedding").limit(k).collect()
    return [list(r.embedding) for r in rows]


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: int = 1, depth: int = 3) -> tuple[DataFrame, list[list[int]], list[int]]:
    """(assignments, centroids, inertias) of ``rounds`` of Lloyd's algorithm on floor(scale * x).

    ``assignments`` has one row (vec_id, cluster, distance) per kept row of ``vectors`` (vec_id,
    embedding): those of exactly ``dimension`` components, none null or non-finite.  Each round
    takes every vector to its nearest centroid by squared distance (ties: smaller number) and
    replaces a centroid that has vectors by the floor of their mean; a last assignment follows.
    ``inertias`` has the exact sum of distances of each cluster.  Repeated ids are vectors of their
    own; a null vec_id is kept but starts no centroid; fewer than k named vectors start as many
    centroids, none give no rows.  A distance beyond a long comes out as null.  Other columns are
    not read.
    """
    spark = vectors.sparkSession
    dtype = np.float64 if dict(vectors.dtypes)["embedding"] == "array<double>" else np.float32
    blocks = packed(vectors, dimension)
    start = start_vectors(vectors, k, dimension, seed)
    schema = "vec_id long, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], schema), [], []
    centroids = as_integers(scaled_floor(np.array(start, np.float64), scale)).tolist()

    def opened(data: bytes) -> np.ndarray:
        return scaled_floor(np.frombuffer(data, dtype).reshape(-1, dimension), scale)

    def summed(known: list[list[int]]) -> list[tuple[int, int, list[int]]]:
        """(vectors, sum of distances, sums of components) of every centroid's vectors."""

        def add(state: list, block) -> list:
            rows = opened(block.data)
            number, squares = nearest(rows, known)
            for c in np.unique(number).tolist():
                mine = np.flatnonzero(number == c)
                state[c] = merge(state[c], (len(mine), sum(squares[i] for i in mine.tolist()), exact_sum(rows[mine])))
            return state

        def merge(a: tuple, b: tuple) -> tuple:
            return a[0] + b[0], a[1] + b[1], [x + y for x, y in zip(a[2], b[2])]

        zero = [(0, 0, [0] * dimension)] * len(known)
        return blocks.select("data").rdd.treeAggregate(zero, add, lambda a, b: [merge(x, y) for x, y in zip(a, b)], depth)

    for _ in range(rounds):
        centroids = [[s // n for s in sums] if n else old for old, (n, _, sums) in zip(centroids, summed(centroids))]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("data")):
                number, squares = nearest(opened(data.as_py()), centroids)
                fit = pa.array([d if d < 1 << 63 else None for d in squares], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(number.astype(np.int32)), fit], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(assigned, schema), centroids, [s for _, s, _ in summed(centroids)]


def centroid_digest(components: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, components)).encode()).hexdigest()


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    rows, centroids, inertias = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster")) if values else F.lit(None)
    whole = sum(inertias)
    return rows.select(
        "vec_id",
        "cluster",
        "distance",
        of(inertias).cast("long").alias("cluster_inertia"),
        F.lit(whole).cast("long").alias("inertia"),
        of([centroid_digest(c) for c in centroids]).cast("string").alias("centroid_sha256"),
    )


def _round_sql(n: int) -> str:
    """DuckDB: a<n>, every vector's nearest centroid of c<n>, and c<n + 1>, the centroids after it."""
    return f"""
d{n} AS (SELECT vec_id, x, number, list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT AS distance FROM kept, c{n}),
a{n} AS MATERIALIZED (SELECT vec_id, x, number, distance FROM d{n} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, number) = 1),
s{n} AS (SELECT number, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, 65) r(i) GROUP BY number, i),
m{n} AS (SELECT number, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{n} GROUP BY number),
c{n + 1} AS MATERIALIZED (SELECT c{n}.number, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} ON c{n}.number = m{n}.number)"""


OP12_SQL = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS number, x AS c FROM kept QUALIFY number < 16),
{",".join(_round_sql(n) for n in range(4))}
SELECT vec_id, a3.number::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY a3.number)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.number = c3.number
"""
