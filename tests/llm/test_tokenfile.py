import io
import zlib

import numpy as np
import pytest

from siftwell.llm import tokenfile as t
from siftwell.llm.tokenids import default_path

from tests.llm.test_packing import plain

WORDS = default_path("word_bpe_49k.json")


def sample(n, kinds, seed):
    rng = np.random.default_rng(seed)
    return np.minimum(rng.geometric(min(1, 3 / kinds), n), kinds).astype(np.uint32)


@pytest.mark.parametrize("n,kinds,lanes,block", [(0, 3, 8, 100), (1, 1, 8, 100), (999, 1, 64, 100), (5000, 40, 7, 1000), (70000, 49000, 256, 1 << 15), (3, 70000, 9, 2)])
def test_round_trip(n, kinds, lanes, block):
    ids = sample(n, kinds, n)
    lengths = [n // 2, 0, n - n // 2]
    data = t.encode_file([5, None, -7], lengths, ids, lanes=lanes, block_tokens=block)
    file = t.TokenFile(io.BytesIO(data))
    got = list(file.documents())
    assert [(d, s) for d, s, _ in got] == [(5, 0), (None, n // 2), (-7, n // 2)]
    assert b"".join(x for *_, x in got) == ids.astype("<u4").tobytes()
    assert [x for k in range(len(file.header["checkpoints"]) or 1) for x in file.documents(k)] == got
    many = t.TokenFile(io.BytesIO(t.encode_file(list(range(n)), [1] * n, ids, lanes=lanes, block_tokens=block))) if n < 6000 else file
    assert [x for k in range(len(file.header["checkpoints"]) or 1) for x in many.documents(k)] == list(many.documents())
    for k in reversed(range(len(file.header["checkpoints"]))):  # blocks decode by themselves
        first, count = file.header["checkpoints"][k][2:4]
        assert (file.block(k) == ids[first : first + count]).all()


def test_it_compresses_near_the_entropy():
    ids = sample(400000, 300, 1)
    p = np.bincount(ids)[1:] / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(t.encode_file([1], [len(ids)], ids)) < 1.05 * entropy + 20000


def test_damage_is_found():
    ids = sample(20000, 300, 2)
    data = t.encode_file([1], [len(ids)], ids, block_tokens=5000)
    for at in range(9, len(data), 1999):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(t.CorruptFile):
            list(t.TokenFile(io.BytesIO(bytes(bad))).documents())
    with pytest.raises(t.CorruptFile):
        list(t.TokenFile(io.BytesIO(data[:-5])).documents())


def test_query_equals_the_library(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want, start = [], 0
    for (doc_id, _), ids in zip(docs, plain(WORDS, [x for _, x in docs])):
        ids += b"\1\0\0\0"
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(tuple(r) for r in t.op7_token_file(spark, "/root/testdata/sf0.001").collect()) == want


def test_odd_rows(spark):
    rows = [(3, "b c", 1), (3, "a", 1), (None, "x", 1), (1, None, 1), (-4, "", 1), (3, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    for kw in ({}, {"file_tokens": 2}, {"block_tokens": 2}, {"file_tokens": 5, "block_tokens": 1}):
        files = t.write_ids(docs, t.fresh_dir(spark, "test"), WORDS, **kw)
        got = sorted((tuple(r) for r in t.read_ids(spark, files).drop("ids").collect()), key=lambda r: r[1])
        assert got == [(None, 0, 2), (-4, 2, 1), (1, 3, 1), (3, 4, 2), (3, 6, 2), (3, 8, 3)]
    none = t.write_ids(docs.limit(0), t.fresh_dir(spark, "test"), WORDS)
    assert none.count() == 0 and t.read_ids(spark, none).count() == 0


def test_many_blocks_share_tasks_and_one_doc_id_spreads_over_files(spark, monkeypatch):
    monkeypatch.setattr(t, "TASK_BLOCKS", 7)
    rows = [(1, f"word {i} " * 20) for i in range(400)] + [(k, "x y z") for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small ranges are one task
    try:
        files = t.write_ids(docs, t.fresh_dir(spark, "test"), WORDS, file_tokens=500, block_tokens=40)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.where("before = 0").count() == 1 and len({r.path.split("-")[-2] for r in files.collect()}) > 1
    blocks = files.agg({"blocks": "sum"}).first()[0]
    read = t.read_ids(spark, files)
    assert blocks > 200 and read.rdd.getNumPartitions() < blocks / 4
    want = [(i, text) for i, text in sorted(rows)]
    got = sorted(read.collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    ids = [x + b"\1\0\0\0" for x in plain(WORDS, [x for _, x in want])]
    assert [bytes(r.ids) for r in got] == ids and [r.start for r in got] == [sum(len(x) // 4 for x in ids[:k]) for k in range(len(ids))]
