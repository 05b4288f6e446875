import hashlib
import math

import numpy as np
import pytest

from siftwell.llm import centroids

from tests.duck import compare

SF = "/root/testdata/sf0.001"


def brute(rows, k, rounds, dimension, scale):
    """Assignments, centroids and inertias in Python integers."""
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e300 else scale * int(x) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    found = [v for _, v in named[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((far(x, c), n) for n, c in enumerate(found))
    for _ in range(rounds if found else 0):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        found = [[sum(column) // len(groups[n]) for column in zip(*groups[n])] if n in groups else c for n, c in enumerate(found)]
    out = [(i, *reversed(near(x))) for i, x in kept] if found else []
    return out, found, [sum(d for _, c, d in out if c == n) for n in range(len(found))]


def check(spark, rows, kind="double", k=3, dimension=4):
    df = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], 7) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int").repartition(3)
    got, found, inertias = centroids.cluster(df, k=k, dimension=dimension)
    want, centers, sums = brute(rows, k, 3, dimension, 64)
    assert (found, inertias) == (centers, sums)
    want = [(i, c, d if d < 1 << 63 else None) for i, c, d in want]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_equals_integers_at_every_magnitude(spark):
    rng = np.random.default_rng(5)
    for scale in (1.0, 2.0**21, 2.0**40, 1e100, 1.7e308):
        check(spark, [(i, (rng.normal(size=4).clip(-1, 1) * scale).tolist()) for i in range(40)])
    # a few large rows among small ones: both paths in one block
    mixed = [(i, (rng.normal(size=4) * (1e12 if i % 9 == 0 else 1)).tolist()) for i in range(50)]
    check(spark, mixed)


def test_float_path_is_exact_up_to_its_bound():
    rng = np.random.default_rng(3)
    for bits in (20, 22, 23, 24, 25, 28, 31, 33):
        rows = rng.integers(-(2**bits), 2**bits, (60, 64)).astype(np.float64)
        known = rng.integers(-(2**bits), 2**bits, (7, 64)).tolist()
        number, squares = centroids.nearest(rows, known)
        table = [[sum((int(a) - b) ** 2 for a, b in zip(x, c)) for c in known] for x in rows.tolist()]
        assert squares == [min(t) for t in table] and number.tolist() == [t.index(min(t)) for t in table]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0, 0, 0]), (1, [0.5, 0, 0, 0]), (1, [0.25, 1, 0, 0]), (None, [0.0, 0, 0, 1]), (None, None), (2, None), (3, []), (4, [1.0, 2, 3]),
        (5, [1.0, None, 0, 0]), (6, [nan, 0.0, 0, 0]), (7, [inf, 0.0, 0, 0]), (8, [-inf, 0.0, 0, 0]), (9, [-0.01, -1, 2, 3]), (10, [1.0] * 5000), (11, [0.0, 0, 0, 0]),
    ]
    check(spark, rows)
    check(spark, rows, "float")
    check(spark, [(i, [1.0, 1, 1, 1]) for i in range(9)])  # ties: smaller number; empty centroids stay
    check(spark, rows[:2], k=5)  # fewer vectors than centroids
    check(spark, [(None, [1.0, 2, 3, 4])])
    check(spark, [])


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf_dir):
    compare(centroids.op12_centroid_clusters(spark, sf_dir), centroids.OP12_SQL, sf_dir)
