import hashlib
import re

import pytest

from siftwell.llm import exactdedup

from tests.duck import compare

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "  \n\t", "a b", "ab ", "a b", "a\nb\r\x0b\x0cx", "abx", "\U0001f600 é", "\U0001f600é\t\t", "é", "é", "x " * 40000, "x" * 40000, "copy of all", "copyofall"]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    for text, found in groups.items():
        for one in found:
            yield one[3], min(found)[3], len(found), hashlib.sha256(text.encode()).hexdigest()


def frame(spark, rows):
    clash = "doc_id long, text string, digest string, points string, number int, best int, row int, short int, known int, kept boolean"
    return spark.createDataFrame([(i, t, "d", "p", 1, 2, 3, 4, 5, False) for i, t in rows], clash)


@pytest.mark.parametrize("heavy", [1, 4, 512])
def test_equals_brute_force(spark, heavy):
    rows = list(enumerate(TEXTS)) + [(100 + i, "hot  text" if i % 3 else "hottext") for i in range(60)] + [(None, "a b"), (None, None), (3, "a b"), (3, "a b"), (None, "alone")]
    docs = frame(spark, rows).repartition(5)
    got = exactdedup.duplicate_groups(docs, heavy=heavy).collect()
    want = list(brute(rows))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({w[3] for w in want}) and all(r.doc_id == r.keep_id for r in kept)
    left = exactdedup.deduplicate(docs, heavy=heavy)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((r.keep_id for r in kept), key=str)


def test_empty_table(spark):
    docs = frame(spark, [(1, "x")]).limit(0)
    assert exactdedup.duplicate_groups(docs).count() == 0 and exactdedup.deduplicate(docs).count() == 0


def test_heavy_hitters_are_all_found_and_verified(spark):
    # a third of the rows one text, the rest mostly different: over many partitions no frequent digest is lost
    rows = [(i, f"only {i}" if i % 3 else "hot") for i in range(3000)] + [(5000 + i, f"warm {i % 5}") for i in range(400)]
    marks = exactdedup.marked(frame(spark, rows).select("doc_id", "text").repartition(16))
    found = {bytes(r.digest).hex(): r.group_size for r in exactdedup.heavy_hitters(marks, 64).collect()}
    sizes = {}
    for _, _, n, digest in brute(rows):
        sizes[digest] = n
    assert found == {d: n for d, n in sizes.items() if n * 64 > len(rows)} and len(found) == 6


def test_plan_is_native_and_heavy_rows_meet_a_broadcast(spark):
    plan = exactdedup.op11_exact_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, sf_dir):
    compare(exactdedup.op11_exact_dedup(spark, sf_dir), exactdedup.OP11_SQL, sf_dir)
