import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import substrings as s
from siftwell.llm import wordhash
from siftwell.llm.arrowtext import utf8_parts


def split(text):
    return (text or "").encode().split()


def brute(rows, window):
    """(doc_id, words, kept) of every row."""
    low = {}
    for doc_id, text in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            if doc_id is not None:
                key = tuple(w[i : i + window])
                low[key] = min(doc_id, low.get(key, doc_id))
    out = []
    for doc_id, text in rows:
        w = split(text)
        gone = set()
        if doc_id is not None:
            for i in range(len(w) - window + 1):
                if low[tuple(w[i : i + window])] < doc_id:
                    gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=repr)


def texts(seed, n, size):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "é", "word", "Word", "x.", "the"] + [f"w{i}" for i in range(30)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, size))] for _ in range(8)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages) if rng.random() < 0.7 else [rng.choice(vocabulary) for _ in range(rng.randrange(size))]
            a = rng.randrange(len(p) + 1) if rng.random() < 0.5 else 0
            parts += p[a : a + rng.randrange(1, size)]
        rows.append((rng.randrange(n), rng.choice([" ", "  ", "\n"]).join(parts)))
    rows += [(None, rows[0][1]), (3, None), (4, ""), (5, " \n "), rows[1], rows[2]]
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (n + 2, "z " + rows[4][1])]
    return rows


@pytest.mark.parametrize("seed,n,size,window", [(1, 60, 30, 6), (2, 40, 25, 10), (3, 80, 60, 6), (4, 30, 300, 50)])
def test_removal_equals_brute_force(spark, seed, n, size, window):
    rows = texts(seed, n, size)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, mark int").repartition(3)
    want = brute(rows, window)
    assert any(r[2] for r in want)
    assert sorted((tuple(r) for r in s.remove_repeats(docs, window).collect()), key=repr) == want


def test_with_many_slices_and_without_broadcast(spark, monkeypatch):
    rows = texts(7, 50, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(s, "LIST_BYTES", 0)
    monkeypatch.setattr(s, "BITS_PER_KEY", 1 << 10)
    made = []
    monkeypatch.setattr(s, "filter_slices", lambda *a, f=s.filter_slices: (made.append(x.bits) or x for x in f(*a)))
    got = sorted((tuple(r) for r in s.remove_repeats(docs, 8, filter_bytes=8 << 10).collect()), key=repr)
    assert got == brute(rows, 8) and made.count(2) >= 4
    assert s.remove_repeats(docs.limit(0)).count() == 0


def test_filter_has_no_false_negatives(spark):
    h = wordhash.mix(np.arange(1, 60001, dtype=np.uint64))
    frame = spark.createDataFrame(pa.table({"h": h.view(np.int64)}))
    other = wordhash.mix(np.arange(10**6, 10**6 + 50000, dtype=np.uint64))
    for most, bits in ((1 << 20, 0), (16 << 10, 2)):
        parts = list(s.filter_slices(frame, most))
        assert len(parts) == 1 << bits and all(x.table.nbytes <= most for x in parts)
        held = sum(x.might_hold(h).astype(int) for x in parts)
        assert (held == 1).all() and sum(x.might_hold(other) for x in parts).mean() < 0.05


def test_words_and_windows_of_buffers():
    rng = random.Random(5)
    for _ in range(50):
        column = pa.array(["".join(rng.choices([" ", "\n", "a", "bc", "é", " ", "x"], k=rng.randrange(12))) for _ in range(6)])
        array, ends = utf8_parts(column)
        starts, stops, first = wordhash.words(array, ends)
        got = [array[a:b].tobytes() for a, b in zip(starts, stops)]
        assert got == [w for t in column.to_pylist() for w in split(t)]
        assert np.diff(first).tolist() == [len(split(t)) for t in column.to_pylist()]
        hashes = wordhash.word_hashes(array, starts, stops)
        assert len(set(zip(got, hashes.tolist()))) == len(set(got)) == len(set(hashes.tolist()))
        at, h = wordhash.windows(hashes, first, 2)
        pairs = [(got[i], got[i + 1]) for i in at.tolist()]
        assert len(set(zip(pairs, h.tolist()))) == len(set(pairs)) == len(set(h.tolist()))
        assert len(at) == sum(max(0, n - 1) for n in np.diff(first).tolist())


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows, 50)]
    assert sum(r[2] for r in want) > 0
    assert sorted(tuple(r) for r in s.op10_substring_dedup(spark, "/root/testdata/sf0.01").collect()) == sorted(want)
