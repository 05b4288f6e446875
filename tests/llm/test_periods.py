import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from siftwell.llm import periods

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    """Every maximal stretch with smallest period q, by trying all periods."""
    n, found = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and w[k] == w[k + q]:
                k += 1
            if k + q - i >= max(24, 3 * q):
                found.setdefault((i, k + q - i), q)  # smaller periods come first
            i = k
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    words = [x for x in re.split("[\x20\x09-\x0d]+", text or "") if x]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    milli = top and 1000 * top[1] // top[2]
    kept = " ".join(x for i, x in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *(top or (None, None, None)), milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def sequences():
    rng = random.Random(7)
    for n in range(70):
        yield [0] * n
    for trial in range(400):
        letters = rng.choice([1, 2, 2, 3, 5, 40])
        n, w = rng.randrange(20, 260), []
        while len(w) < n:
            part = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 33, 60]))]
            w += part * rng.choice([1, 1, 2, 3, 3, 4, 9]) + part[: rng.randrange(len(part) + 1)]
            if rng.random() < 0.2 and len(w) > 3:
                w += w[-rng.randrange(1, len(w)) :]  # runs made of runs
        yield w
    yield ([0] * 30 + [1]) * 5
    yield (([0] * 30 + [1]) * 4 + [2]) * 4
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    yield fib[-1]


def test_runs_equal_brute_force():
    for w in sequences():
        assert periods.word_runs(np.array(w, np.int64)) == brute_runs(w), w


def test_long_texts_of_one_word_or_line_cost_in_proportion():
    import time

    def seconds(n):
        line = list(range(50))
        texts = [[0] * n, line * (n // 50), ([0] * 40 + [1]) * (n // 41)]
        began = time.perf_counter()
        for w in texts:
            assert periods.word_runs(np.array(w, np.int64))[0][:2] in ((0, len(w)), (0, 40))
        return time.perf_counter() - began

    small, large = seconds(20_000), seconds(160_000)
    assert large < 24 * small


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, start int, runs string")


def test_operator_and_odd_rows(spark):
    line = "all rights reserved by the owner of this page "
    rows = [(1, line * 9 + "end"), (2, None), (3, " \n"), (4, "w " * 23), (5, "w " * 24), (None, "x y " * 20), (1, line * 9 + "end"), (6, "a b c " * 12), (7, "")]
    got = periods.periodic_runs(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in got}
    assert by[1] == ([(0, 81, 9)], line + "end") and by[2] == by[3] == by[7] == ([], "")
    assert by[4][0] == [] and by[5] == ([(0, 24, 1)], "w") and by[None] == ([(0, 40, 2)], "x y") and by[6] == ([(0, 24, 2)], "a b c")
    assert periods.periodic_runs(docs(spark, rows).limit(0)).count() == 0


def query_rows(spark, folder):
    got = periods.op13_periodic_runs(spark, folder).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_query_on_planted_ends_and_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.choice([0, 1, 2, 30, 90, 300])))) for i in range(300)]
    rows += [(i, None) for i in range(300, 330)] + [(i, "\t\n ") for i in range(330, 360)] + [(None, "q r " * 30), (None, None), (5, "ab " * 99), (5, "ab " * 99)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert query_rows(spark, str(tmp_path)) == sorted((brute(*r) for r in rows), key=str)


@pytest.mark.parametrize("sf_dir", [SF])
def test_query_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len((r.text or "").split()) < 3000]
    ids = {r.doc_id for r in short}
    got = query_rows(spark, sf_dir)
    assert len(got) == len(rows)
    assert [r for r in got if r[0] in ids] == sorted((brute(*r) for r in short), key=str)
