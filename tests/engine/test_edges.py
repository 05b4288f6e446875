"""Odd pages and sources: nothing crashes, nothing grows with the square of a page."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell.functions.html import page, parse
from siftwell.operators import requests, ssg
from siftwell.plans.prune import checked, parsed, prune
from siftwell.sources import pages, sitemap
from siftwell.operators import extract

PAGES = "/root/testdata/sf0.001/pages.parquet"


def test_unclosed_paragraphs_take_space_in_proportion(spark):
    html = "<html><body>" + "".join(f"<p>Paragraph number {k} of many that nobody closes\n" for k in range(20000)) + "</html>"
    assert len(html) > 900_000
    found = page(html)
    assert sum(len(e["text"] or "") for e in found["elements"]) <= len(html) and parse(html).elements[-1].tag == "p"
    row = parsed(spark.createDataFrame([(html,)], "html string")).select(F.size(extract.l1_nodes(F.col("dom.elements"))).alias("n")).first()
    assert row.n == 1


def test_nested_content_stays_where_a_walk_can_start_inside(spark):
    html = "<body><p>outer words <div><p>inner words that are long enough</p><article><li>item words in here</li></article></div></p></body>"
    texts = {e["tag"]: e["text"] for e in page(html)["elements"]}
    assert texts["li"] == "item words in here" and len([e for e in page(html)["elements"] if e["tag"] == "p"]) == 2


@pytest.mark.parametrize("about", [5, ["x"], {"a": 1}, "\ud800 lone", None, True])
def test_odd_payloads_do_not_fail_the_job(spark, about):
    content = ["$", "p", None, {"children": "words and \ud800 more words " * 10}]
    payload = json.dumps({"props": {"pageProps": {"content": content, "description": about}}})
    got = spark.createDataFrame([(payload,)], "p string").select(ssg.ssg_markdown(F.col("p")).alias("s")).first().s
    assert got.markdown.startswith("words and ? more") and isinstance(got.meta_desc, str)


def test_a_page_is_parsed_once_in_each_plan(spark):
    for frame in (checked(prune(spark.read.parquet(PAGES))), checked(prune(spark.read.parquet(PAGES), "some query")).where("refined_tokens > 3")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 2 and plan.count("_pages(") <= 2 and "error" not in frame.columns


def test_missing_and_failed_pages_raise_unless_ignored(spark):
    body = "<body>" + "".join(f"<p>Paragraph number {k} with words enough to count</p>" for k in range(6)) + "</body>"
    table = spark.createDataFrame([("http://a", body, None), ("http://b", None, "HTTP status 500")], "url string, html string, fetch_error string")
    urls = pages.url_list(spark, ["http://a", "http://b", "http://c"])
    assert [r.ord for r in pages.retrieve(table, urls, "").collect()] == [0] and pages.load_batch(table, urls).count() == 1
    assert {r.error for r in prune(table).collect()} == {None, "HTTP status 500"}
    for some, message in ((["http://a", "http://c"], "No such page: http://c"), (["http://b"], "HTTP status 500")):
        for load in (pages.load_batch, lambda *a, **k: pages.retrieve(*a, "", **k)):
            with pytest.raises(Exception, match=message):
                load(table, pages.url_list(spark, some), ignore_errors=False).collect()
    with pytest.raises(Exception, match="No such page"):
        pages.load_one(table, "http://d").collect()


def test_sitemaps_of_any_root_and_depth(spark):
    rows = [(f"i{k}", f"<sitemapindex><sitemap><loc>i{k + 1}</loc></sitemap></sitemapindex>") for k in range(14)]
    rows += [("i14", "<feed><url><loc> http://x/1 </loc></url><url><loc>http://x/2</loc></url></feed>")]
    found = sitemap.expand(spark.createDataFrame(rows, "url string, xml string"), "i0")
    assert sorted(r.url for r in found.collect()) == ["http://x/1", "http://x/2"]


def test_null_keys_of_a_request_log_are_one_key(spark):
    rows = [(None, 1, 0.0), (None, 2, 10.0), (7, 3, 5.0), (None, 4, 400.0)]
    frame = spark.createDataFrame(rows, "key long, event_id long, t double")
    got = requests.ttl_hits(frame, "key", F.timestamp_seconds("t"), 300.0)
    assert got.dtypes == [("key", "bigint"), ("event_id", "bigint"), ("hit", "boolean")]
    assert {r.event_id: r.hit for r in got.collect()} == {1: False, 2: True, 3: False, 4: False}
