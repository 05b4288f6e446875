from siftwell.llm import urlfilter as u

from tests.duck import compare

URLS = [
    "http://Example.com/en/a", "https://www.example.com/en/x?utm_source=a", "http://a.example.com/en", "http://x.net/es/1", "http://net/fr/#a",
    "http://mynet/es/", "nourl", "", None, "http://h.org", "http://h.org/", "http://h.org:80/?b=2&a=1&ref=x", "https://h.org?a=1&b=2#f", "x://y://z/p", "http://q.com",
]


def test_rules_hosts_and_list(spark):
    pages = spark.createDataFrame([(i, x, "w") for i, x in enumerate(URLS)] + [(0, URLS[0], None), (None, "http://h.org", "")], "page_id long, url string, host string")
    listed = spark.createDataFrame([("h.org?a=1&b=2",), ("h.org?a=1&b=2",), (None,), ("",), ("unseen.org/x",)], "canonical string")
    rows = u.filter_urls(pages, listed, u.QUERY_RULES).collect()
    assert len(rows) == len(URLS) + 2
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en", "com/", "allow")
    assert got[3] == ("x.net", "/es/1", "net/es/", "block") and got[4][2:] == ("net/fr/", "block")
    assert got[5] == ("mynet", "/es/", None, "allow")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[11][2:] == got[12][2:] == (None, "block") and got[9][3] == "allow"
    assert got[13] == ("y:", "//z/p", None, "allow") and got[14] == ("q.com", "", None, "allow")
    assert u.filter_urls(pages, listed.limit(0), u.QUERY_RULES).where("listed").count() == 0
    assert u.filter_urls(pages.limit(0), listed, []).count() == 0


def test_filter_has_no_false_negatives_and_exact_join_removes_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('h', id, '.org/p') AS canonical")
    pages = spark.range(9000).selectExpr("id AS page_id", "concat('http://h', id, '.org/p') AS url")
    for kw in ({}, {"bits_per_url": 2}, {"broadcast_bytes": 0}):
        got = {r.page_id for r in u.filter_urls(pages, listed, [], **kw).where("listed").collect()}
        assert got == set(range(3000))


def test_a_small_list_costs_one_read_of_the_pages(spark, tmp_path):
    spark.range(50).selectExpr("id AS page_id", "concat('http://h', id, '.org/p') AS url").write.parquet(str(tmp_path / "pages"))
    listed = spark.createDataFrame([("h7.org/p",)], "canonical string")
    found = u.filter_urls(spark.read.parquet(str(tmp_path / "pages")), listed, [])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and [r.page_id for r in found.where("listed").collect()] == [7]


def test_query_equals_sql(spark):
    compare(u.op1_url_filter(spark, "/root/testdata/sf0.01"), u.OP1_SQL, "/root/testdata/sf0.01")
