import json
import math
import random
import re
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from siftwell import queries
from siftwell.functions.text import estimate_tokens, tokenize
from siftwell.operators import bm25, classify, report, requests, ssg
from siftwell.operators.extract import NODE
from siftwell.plans import cli
from siftwell.plans.prune import checked, prune
from siftwell.sources import fetch, pages, sitemap
from siftwell.streaming import pages as streaming

from tests.duck import compare


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    compare(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), queries.ORACLE_SQL[name], "/root/testdata/sf0.001")


def words(text):
    return [w for w in re.split(r"[\s\W]+", text.lower()) if len(w) >= 2]


def model(nodes, query, budget):
    """Sections, BM25+ scores, budget and ancestors, written out plainly."""
    groups = []
    for n in nodes:
        if not groups or re.fullmatch("h[1-5]", n["tag"]):
            groups.append([])
        groups[-1].append(n)
    level = [int(g[0]["tag"][1]) if re.fullmatch("h[1-5]", g[0]["tag"]) else 99 for g in groups]
    head = [words(g[0]["text"]) if x < 99 else [] for g, x in zip(groups, level)]
    body = [[w for n in (g[1:] if x < 99 else g) for w in words(n["text"])] for g, x in zip(groups, level)]
    count = [len(h) + len(b) for h, b in zip(head, body)]
    if not query.strip() or len(groups) <= 2 or sum(count) <= budget or not words(query):
        return nodes, 0.0

    def score(corpus):
        average = sum(map(len, corpus)) / len(corpus)
        out = [0.0] * len(corpus)
        for q in words(query) if average else []:
            df = sum(q in d for d in corpus)
            for i, d in enumerate(corpus):
                tf = d.count(q)
                out[i] += math.log((len(corpus) + 1) / df) * (1 + tf * 2.5 / (1.5 * (0.25 + 0.75 * len(d) / average) + tf)) if df else 0.0
        return out

    depth = [min([x if x < 99 else 999] + [n["depth"] for n in (g[1:] if x < 99 else g)]) for g, x in zip(groups, level)]
    depth = [0 if d >= 999 else d for d in depth]
    span = max(1, max(depth) - min(depth))
    total = [b * (1 - 0.4 * (d - min(depth)) / span) + 2.5 * h for b, h, d in zip(score(body), score(head), depth)]
    if max(total) == 0:
        return nodes, 0.0
    taken, used = [], 0
    for i in sorted(range(len(total)), key=lambda i: -total[i]):
        if used + count[i] > budget and len(taken) >= 2:
            break
        taken.append(i)
        used += count[i]
    kept = set(taken)
    for i in taken:
        for j in range(i):
            if level[j] < min(99, level[i]) and all(level[k] > level[j] for k in range(j + 1, i)):
                kept.add(j)
    return [n for i in sorted(kept) for n in groups[i]], max(total)


def random_nodes(rng):
    vocabulary = ["install", "pip", "python", "create_task", "the", "x", "Größe", "日本語", "a", "run"]
    tags = ["p", "p", "li", "h1", "h2", "h3", "h4", "h5"]
    out = []
    for i in range(rng.randrange(0, 30)):
        tag = rng.choice(tags)
        text = "" if rng.random() < 0.05 else " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))
        out.append({"pos": i, "tag": tag, "text": text, "depth": rng.randrange(1, 9), "code_lang": None, "cells": None, "is_header": False})
    return out


def test_section_filter_equals_the_model(spark):
    rng = random.Random(3)
    cases = [(i, random_nodes(rng), rng.choice(["install python", "pip pip", "missing words", " ", "x", "größe 日本語 the"]), rng.choice([5, 12, 40, 1200])) for i in range(250)]
    frame = spark.createDataFrame(cases, f"i int, nodes array<{NODE}>, q string, budget int")
    rows = frame.select("i", bm25.bm25_filter(F.col("nodes"), F.col("q"), F.col("budget")).alias("r")).collect()
    picked = 0
    for r in rows:
        _, nodes, q, budget = cases[r.i]
        want, confidence = model(nodes, q, budget)
        assert [n.pos for n in r.r.nodes] == [n["pos"] for n in want]
        assert abs(r.r.confidence - confidence) < 1e-9
        picked += confidence > 0
    assert picked > 50


def test_text_primitives(spark):
    texts = ["", "a" * 400, "create_task(x) — Größe, 日本語 a1 b", "  x y"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokenize(F.col("t")).alias("w"), estimate_tokens(F.col("t")).alias("n")).collect()
    assert all(r.w == words(r.t) and r.n == max(1, len(r.t) // 4) for r in rows)


CONTENT = [["$", "h1", None, {"children": ["Install ", ["$", "code", None, {"children": "pip"}]]}], ["$", "p", None, {"children": "word " * 30}]]


def next_page(content, **props):
    return '<script id="__NEXT_DATA__" type="x">' + json.dumps({"props": {"pageProps": {"content": content, **props}}}) + "</script>"


def test_static_pages(spark):
    cases = {
        "static": next_page(CONTENT), "text": next_page(json.dumps(CONTENT)), "short": next_page(["few words"]) + "<p>a paragraph of the page itself</p>",
        "falsy": '<script id="__NEXT_DATA__">{}</script><p>a paragraph of the page itself</p>', "second": '<script id="__NEXT_DATA__">{bad</script>window.page = {"a": 1};<p>a paragraph of the page</p>',
        "csr": "<p></p>" + "<b></b>" * 200, "null": None,
    }
    rows = {r.url: r for r in prune(spark.createDataFrame(list(cases.items()), "url string, html string")).collect()}
    kinds = {u: r.render_type for u, r in rows.items()}
    assert kinds == {"static": "SSG", "text": "SSG", "short": "SSR", "falsy": "SSR", "second": "SSR", "csr": "CSR", "null": "CSR"}
    assert rows["static"].markdown.startswith("# Install `pip`\nword") and rows["static"].markdown == rows["text"].markdown
    assert rows["csr"].error and rows["null"].error and not rows["short"].error
    kept = checked(spark.createDataFrame(list(rows.values()), prune(spark.createDataFrame([], "url string, html string")).schema))
    assert kept.count() == 5
    with pytest.raises(Exception, match="No extractable content"):
        checked(prune(spark.createDataFrame([("u", "")], "url string, html string")), ignore_errors=False).collect()


def test_static_rendering():
    t = lambda tag, child, **p: ["$", tag, None, {"children": child, **p}]
    assert ssg.inline([t("code", "x"), t("strong", "b"), t("em", "i"), t("a", "l"), 3, None, True, {"a": 1}]) == "`x`**b**_i_l"
    assert ssg.blocks(t("h5", "T")) == ["#### T"] and ssg.blocks(t("Meta", "x")) == [] and ssg.blocks(t("nav", t("p", "in"))) == ["in"]
    assert ssg.blocks(t("ul", [t("li", "one"), t("li", " ")])) == ["- one"] and ssg.blocks(t("blockquote", [t("p", "a"), t("p", "b")])) == ["> a", "> b"]
    assert ssg.blocks(t("pre", t("code", "x = 1\n", className="language-py"))) == ["```py", "x = 1", "```"] and ssg.blocks(t("pre", "y ")) == ["```", "y", "```"]
    assert ssg.single_blanks(["a", "", "", "b", ""]) == ["a", "", "b", ""]
    assert ssg.render("not json") is None and ssg.render(json.dumps({"props": {}})) is None and ssg.render("[1]") is None


def test_query_on_static_page_selects_elements(spark):
    body = "".join(f"<h2>Part {i} {'install' if i == 3 else ''}</h2><p>{f'filler{i} ' * 700}</p>" for i in range(6))
    page = spark.createDataFrame([("u", next_page(CONTENT) + f"<body>{body}</body>")], "url string, html string")
    hit, miss, none = (prune(page, q).first() for q in ("install", "nowhere", ""))
    assert hit.bm25_confidence > 0 and "Part 3" in hit.markdown and "Part 5" not in hit.markdown and hit.refined_tokens < 4000
    assert miss.bm25_confidence == 0.0 and miss.markdown == none.markdown and none.bm25_confidence is None


def test_payload_choice(spark):
    rows = spark.createDataFrame([("window.__NUXT__ = {\"a\":1};",), ("window.page = {};",), ("x",)], "h string").select(classify.is_static(classify.ssg_payload(F.col("h")))).collect()
    assert [r[0] for r in rows] == [True, False, False]


def test_request_folds_equal_models(spark):
    rng = random.Random(9)
    log = [(i, f"k{rng.randrange(12)}", float(rng.randrange(400))) for i in range(500)]
    frame = spark.createDataFrame(log, "event_id long, key string, s double").withColumn("ts", F.timestamp_seconds("s"))
    for ttl in (30.0, 1.0, 0.0):
        until, want = {}, {}
        for i, k, t in sorted(log, key=lambda r: (r[2], r[0])):
            want[i] = ttl > 0 and t < until.get(k, -1)
            until[k] = until[k] if want[i] else t + ttl
        assert {r.event_id: r.hit for r in requests.ttl_hits(frame, "key", F.col("ts"), ttl).collect()} == want
    entries, want = OrderedDict(), {}
    for i, k, t in sorted(log, key=lambda r: (r[2], r[0])):
        want[i] = k in entries and t < entries[k]
        if want[i]:
            entries.move_to_end(k)
        else:
            for dead in [x for x, e in entries.items() if t >= e]:
                del entries[dead]
            while len(entries) >= 5:
                entries.popitem(last=False)
            entries[k] = t + 60
    rows = requests.lru_cache(frame, "key", F.col("ts"), ttl=60.0, max_size=5).collect()
    assert {r.seq: r.hit for r in rows} == want and max(r.size for r in rows) == 5
    assert requests.lru_cache(frame, "key", F.col("ts"), ttl=0).where("hit").count() == 0


def test_sources(spark):
    table = spark.createDataFrame([("http://a/1", "<p>first page of the table</p>"), ("http://a/2", "<p>second page of the table</p>"), ("http://b/3", "")], "url string, html string")
    urls = pages.url_list(spark, ["http://a/2", "http://b/3", "http://a/1", "http://a/2"])
    got = pages.retrieve(table, urls, "words").collect()
    assert [r.ord for r in got] == [0, 2, 3] and got[0].page_content == "second page of the table" and got[0].metadata["source"] == "http://a/2"
    assert pages.load_batch(table, urls).count() == 3 and pages.load_one(table, "http://a/1").count() == 1
    with pytest.raises(Exception, match="No extractable content"):
        pages.load_batch(table, urls, ignore_errors=False).collect()
    assert json.loads(pages.to_json(prune(table)).where("url = 'http://a/1'").first().json)["bm25_confidence"] is None
    xml = [("r", "<sitemapindex><sitemap><loc>s</loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>"), ("s", "<urlset><url><loc> http://a/1 </loc></url><url><loc>http://b/3</loc></url><url/></urlset>")]
    maps = spark.createDataFrame(xml, "url string, xml string")
    assert sitemap.expand(maps, "s").count() == 2 and sitemap.expand(maps, "r", 3).count() == 4
    assert sitemap.load_sitemap(table, maps, "s", prefixes=["http://a/"]).count() == 1


def test_sitemaps_deeper_than_ten_levels_and_cycles(spark):
    index = lambda at: f"<sitemapindex><sitemap><loc>{at}</loc></sitemap></sitemapindex>"
    xml = [(str(i), index(i + 1)) for i in range(11)] + [("11", "<urlset><url><loc>http://a/1</loc></url></urlset>"), ("x", index("y")), ("y", index("x"))]
    maps = spark.createDataFrame(xml, "url string, xml string")
    assert [r.url for r in sitemap.expand(maps, "0").collect()] == ["http://a/1"]
    with pytest.raises(ValueError, match="below itself"):
        sitemap.expand(maps, "x")


def test_fetch_of_a_table(spark):
    def get(url, headers, timeout):
        if "down" in url:
            raise OSError("no route")
        return (404, "", url) if "gone" in url else (200, "html of " + url, url + "/")

    def browser(url):
        raise RuntimeError("no browser for " + url)

    urls = [f"http://h{i}" for i in range(40)] + ["http://h1", None, "", "http://gone", "http://down"]
    table = spark.createDataFrame([(x, "clash") for x in urls], "link string, html string")
    rows = {r.request_url: r for r in fetch.fetch_table(table, "link", in_flight=4, get=get, browser=browser).collect()}
    assert set(rows) == {x for x in urls if x}
    assert rows["http://h7"].html == "html of http://h7" and rows["http://h7"].url == "http://h7/" and rows["http://h7"].fetch_error is None
    assert "404" in rows["http://gone"].fetch_error and rows["http://down"].fetch_error == "no browser for http://down"
    assert fetch.fetch_table(table.limit(0), "link", get=get).count() == 0


def test_fetch_tiers():
    calls = []

    def get(answers):
        it = iter(answers)

        def one(url, headers, timeout):
            calls.append(headers["User-Agent"])
            status = next(it)
            if status is None:
                raise OSError("down")
            return status, f"html {status}", url + "/"

        return one

    assert fetch.fetch("u", get=get([200])) == ("html 200", "u/")
    assert fetch.fetch("u", get=get([403, 200])) == ("html 200", "u/") and calls[-1] == fetch.USER_AGENTS[1]
    assert fetch.fetch("u", get=get([429, None, 403]), browser=lambda u: ("browser", u)) == ("browser", "u")
    with pytest.raises(RuntimeError, match="404"):
        fetch.fetch("u", get=get([404]))


def test_page_source_reports_failures(spark):
    spark.dataSource.register(fetch.PageSource)
    rows = spark.read.format("webpage").option("urls", "http://127.0.0.1:9/a\nnot-a-url").option("timeout", "0.2").load().collect()
    assert len(rows) == 2 and all(r.html is None and r.fetch_error for r in rows)


def test_cli(spark, tmp_path, capsys):
    spark.createDataFrame([("http://a", "<title>T</title><p>some words of the page</p>")], "url string, html string").write.parquet(f"{tmp_path}/p")
    assert cli.main(["http://a", "--pages", f"{tmp_path}/p"]) == 0
    out = capsys.readouterr().out
    assert "Title        : T" in out and "BM25 score   : —" in out and out.rstrip().endswith("some words of the page")
    assert cli.main(["http://a", "q", "--json", "--pages", f"{tmp_path}/p"]) == 0 and json.loads(capsys.readouterr().out)["bm25_confidence"] == 0.0
    assert cli.main(["http://none", "--pages", f"{tmp_path}/p"]) == 1 and "Error" in capsys.readouterr().err


def test_report(spark):
    rows = [("a", 100, 10, 0.0, 0.0, 1.5), ("b", 300, 31, 0.0, 0.0, 0.0), ("c", 1, 1, 0.0, 0.0, None)]
    results = spark.createDataFrame(rows, "url string, original_tokens int, refined_tokens int, fetch_ms double, parse_ms double, bm25_confidence double")
    assert [r.mode for r in report.report_rows(results).orderBy("url").collect()] == ["BM25", "full", "full"]
    r = report.averages(results).first()
    assert (r.pages, r.avg_original, r.avg_refined) == (3, 133, 14) and abs(r.reduction - (1 - 42 / 401)) < 1e-9


def test_streams(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source.write.parquet(f"{tmp_path}/in")
    stream = streaming.prune_stream(streaming.page_stream(spark, f"{tmp_path}/in"))
    q = stream.select("url", "markdown").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == checked(prune(source)).count() == 50
    log = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 5.0), ("a", 31.0), ("a", 45.0)], "key string, t double")
    log.write.parquet(f"{tmp_path}/log")
    hits = streaming.cached_stream(spark.readStream.schema("key string, t double").parquet(f"{tmp_path}/log"), ttl=30.0)
    q = hits.writeStream.format("memory").queryName("hits").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.key, r.t): r.hit for r in spark.table("hits").collect()} == {("a", 0.0): False, ("a", 10.0): True, ("b", 5.0): False, ("a", 31.0): False, ("a", 45.0): True}
    spark.createDataFrame([("a", 0), ("a", 100), ("b", 20)], "key string, s int").select("key", F.timestamp_seconds("s").alias("ts")).write.parquet(f"{tmp_path}/ts")
    windows = streaming.request_windows(spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/ts"))
    q = windows.writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.key: r.requests for r in spark.table("wins").collect()} == {"a": 2, "b": 1}
