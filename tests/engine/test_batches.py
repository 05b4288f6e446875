"""Python workers hold texts a bounded piece at a time."""

import pyarrow as pa

from siftwell.functions.html import _pages
from siftwell.operators.ssg import _rendered
from siftwell.plans.prune import prune

LONG = 400_000


def test_long_pages_come_in_pieces():
    pages = [f"<p>{k} {'word ' * (LONG // 5)}</p>" for k in range(10)] + [None, ""]
    got = list(_pages(iter([pa.array(pages)])))
    assert sum(map(len, got)) == 12 and max(map(len, got)) <= 3
    texts = [[e["text"] for e in d["elements"] if e["tag"] == "p"] for a in got for d in a.to_pylist()]
    assert [t[0].split()[0] if t else None for t in texts] == [*map(str, range(10)), None, None]
    payload = '{"props":{"pageProps":{"content":[["$","p",null,{"children":"%s"}]]}}}'
    got = list(_rendered(iter([pa.array([payload % ("x" * LONG), None] * 6)])))
    assert max(map(len, got)) <= 7 and [x is None for a in got for x in a.to_pylist()] == [False, True] * 6


def test_batches_of_the_session_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "50000")
        rows = spark.range(3).selectExpr("cast(id as string) AS url", "concat('<p>Words of page number ', id, '</p>') AS html")
        assert prune(rows).count() == 3 and int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)
