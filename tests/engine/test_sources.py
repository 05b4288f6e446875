"""Sitemap closures, polite fetching, the sink, and columns of callers that look like our own."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from siftwell.operators import requests
from siftwell.plans.prune import checked, prune, prune_requests
from siftwell.sources import fetch, pages, sink, sitemap

BODY = "<body>" + "".join(f"<p>Paragraph number {k} with words enough to count</p>" for k in range(6)) + "</body>"


# -- sitemaps -------------------------------------------------------------------------------------


def index(*children):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{c}</loc></sitemap>" for c in children) + "</sitemapindex>"


def urlset(*urls):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"


def walked(maps, at):
    """URLs in order, by recursion."""
    kind, found = maps.get(at, ("set", []))
    return [u for c in found for u in walked(maps, c)] if kind == "index" else list(found)


def test_closure_equals_recursion_in_order_with_repeats(spark):
    maps = {
        "root": ("index", ["a", "gone", "b", "a"]), "a": ("index", ["s1", "s2"]), "b": ("index", ["c", "s1"]), "c": ("index", ["a", "s3"]),
        "s1": ("set", ["u1", "u2", "u1"]), "s2": ("set", []), "s3": ("set", ["u3"]), "other": ("set", ["never"]),
    }
    rows = [(u, index(*x) if kind == "index" else urlset(*x), 1) for u, (kind, x) in maps.items()]
    found = sitemap.expand(spark.createDataFrame(rows, "url string, xml string, ord int"), "root")
    assert [r.url for r in found.orderBy("ord").collect()] == walked(maps, "root")
    assert sitemap.expand(spark.createDataFrame(rows, "url string, xml string, ord int"), "nowhere").count() == 0
    assert sitemap.expand(spark.createDataFrame([], "url string, xml string"), "root").count() == 0


def test_wide_trees_never_come_to_the_driver(spark, monkeypatch):
    # 20,000 indexes two levels down, each with one set; the driver may see single rows only
    rows = spark.range(20_000).select(F.concat(F.lit("i"), "id").alias("url"), F.concat(F.lit("<sitemapindex><sitemap><loc>s"), F.col("id") % 97, F.lit("</loc></sitemap></sitemapindex>")).alias("xml"))
    tops = spark.range(100).select(F.concat(F.lit("t"), "id").alias("url"), F.expr("concat('<sitemapindex>', array_join(transform(sequence(0, 199), k -> concat('<sitemap><loc>i', id * 200 + k, '</loc></sitemap>')), ''), '</sitemapindex>')").alias("xml"))
    rest = spark.createDataFrame([("root", index(*(f"t{k}" for k in range(100))))] + [(f"s{k}", urlset(f"http://h/{k}")) for k in range(97)], "url string, xml string")
    collected = []
    kind = type(rows)
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: collected.append(len(found := real(self))) or found)
    found = sitemap.expand(rows.unionAll(tops).unionAll(rest), "root")
    assert max(collected, default=0) <= 1
    monkeypatch.undo()
    assert found.count() == 20_000 and found.select("url").distinct().count() == 97


def test_an_index_below_itself_raises_at_any_distance(spark):
    maps = spark.createDataFrame([("r", index("x", "s")), ("x", index("y")), ("y", index("z")), ("z", index("x")), ("s", urlset("u"))], "url string, xml string")
    with pytest.raises(ValueError, match="below itself: x"):
        sitemap.expand(maps, "r")
    assert sitemap.expand(maps, "r", 4).count() == 1


# -- fetching -------------------------------------------------------------------------------------


@pytest.fixture
def server():
    log, lock, open_now, most = [], threading.Lock(), {}, {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.headers["Host"].split(":")[0]
            with lock:
                log.append((name, self.path, time.monotonic()))
                seen = sum(1 for n, p, _ in log if (n, p) == (name, self.path))
                open_now[name] = open_now.get(name, 0) + 1
                most[name] = max(most.get(name, 0), open_now[name])
            time.sleep(0.01)
            status = 503 if "flaky" in self.path and seen < 3 else 500 if "broken" in self.path else 200
            body = f"<p>page {self.path}</p>".encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)
            with lock:
                open_now[name] -= 1

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield http.server_address[1], log, most
    http.shutdown()


def no_browser(url):
    raise RuntimeError("no browser for " + url)


def test_hosts_are_asked_at_their_rate_and_passing_trouble_again(spark, server):
    port, log, _ = server
    urls = [f"http://{h}:{port}/{k}" for h in ("127.0.0.1", "localhost") for k in range(12)]
    urls += [f"http://127.0.0.1:{port}/flaky", f"http://localhost:{port}/broken", f"http://127.0.0.1:{port}/1"]
    table = spark.createDataFrame([(u,) for u in urls], "url string").repartition(4)
    # the hot host is dealt to three tasks, with a third of the rate each
    got = fetch.fetch_table(table, rate=20.0, burst=1, backoff=0.01, browser=no_browser, host_urls=5, partitions=4).collect()
    rows = {r.request_url: r for r in got}
    assert len(got) == len(set(urls)) and all(r.fetch_ms > 0 for r in got)
    assert rows[f"http://127.0.0.1:{port}/flaky"].html == "<p>page /flaky</p>" and "HTTP status 500" in rows[f"http://localhost:{port}/broken"].fetch_error
    assert sum(p == "/broken" for _, p, _ in log) == 3 and sum(p == "/flaky" for _, p, _ in log) == 3
    for name in ("127.0.0.1", "localhost"):
        times = sorted(t for n, _, t in log if n == name)
        assert len(times) >= 12
        # within any second at most the rate, and one request that each of the tasks may have at once
        assert max(sum(a <= t < a + 1 for t in times) for a in times) <= 20 + 3


def test_token_bucket_by_its_own_clock():
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(round(seconds, 6))
        now[0] += seconds

    bucket = fetch.TokenBucket(4.0, burst=2, clock=lambda: now[0], sleep=sleep)
    for _ in range(5):
        bucket.take()
    assert slept == [0.25, 0.25, 0.25]
    now[0] += 10
    bucket.take(), bucket.take()
    assert len(slept) == 3


def test_no_more_requests_in_flight_than_allowed(spark, server):
    port, _, most = server
    table = spark.createDataFrame([(f"http://127.0.0.1:{port}/{k}",) for k in range(40)], "url string")
    assert fetch.fetch_table(table, in_flight=3, browser=no_browser, partitions=2).where("fetch_error IS NULL").count() == 40
    assert most["127.0.0.1"] <= 3


def test_hosts_of_urls(spark):
    urls = ["http://A.org/x", "https://u:p@b.org:8/?q=http://c", "no url", "http://[bad", "", None, "//x/y", "http://é.org#f"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", fetch.host_of(F.col("u")).alias("h")).collect()
    assert [r.h for r in rows] == ["a.org", "b.org:8", "", "[bad", "", None, "", "é.org"]
    assert [fetch.host(u) for u in urls[:3]] == ["a.org", "b.org:8", ""] and fetch.host("http://[bad") == ""


def test_a_stream_of_urls_goes_on_where_it_stopped(spark, server, tmp_path):
    port, log, _ = server

    def run():
        urls = spark.readStream.schema("link string").parquet(f"{tmp_path}/urls")
        found = fetch.fetch_table(urls, "link", browser=no_browser, partitions=2)
        query = sink.save_stream(prune_fields(found), f"{tmp_path}/out", f"{tmp_path}/c").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(r.request_url for r in sink.saved(spark, f"{tmp_path}/out", "request_url string, html string").collect())

    def prune_fields(df):
        return df.select("request_url", "html")

    first, second = ([f"http://127.0.0.1:{port}/{k}" for k in r] for r in (range(5), range(5, 8)))
    spark.createDataFrame([(u,) for u in first], "link string").write.mode("append").parquet(f"{tmp_path}/urls")
    assert run() == first
    spark.createDataFrame([(u,) for u in second], "link string").write.mode("append").parquet(f"{tmp_path}/urls")
    assert run() == first + second and run() == first + second
    assert len(log) == 8


def site_get(pages, log):
    def get(url, headers, timeout):
        with open(log, "a") as out:
            out.write(url + "\n")
        if url not in pages:
            return 404, "", url
        return 200, pages[url], url + "/" if "/p" in url else url

    return get


def test_a_site_is_loaded_from_its_sitemaps(spark, tmp_path):
    pages = {f"http://s/p{k}": BODY.replace("Paragraph", f"Paragraph of p{k}") for k in range(4)} | {
        "http://s/root": index("http://s/a", "http://s/gone", "http://s/b", "http://s/a"), "http://s/b": index("http://s/a", "http://s/c"),
        "http://s/a": urlset("http://s/p0", "http://s/p1"), "http://s/c": urlset("http://s/p2", "http://s/p3", "http://s/p9", "http://other/p1"),
    }
    log = tmp_path / "log"
    policy = fetch.Policy(get=site_get(pages, str(log)), browser=no_browser)
    found = sitemap.load_site(spark, "http://s/root", prefixes=["http://s/"], policy=policy).collect()
    assert sorted(r.metadata["source"] for r in found) == sorted([f"http://s/p{k}/" for k in (0, 1) for _ in range(3)] + ["http://s/p2/", "http://s/p3/"])
    assert all(f"of {r.metadata['source'][9:11]}" in r.page_content for r in found)
    asked = log.read_text().split()
    assert len(asked) == len(set(asked)) and "http://other/p1" not in asked and "http://s/gone" in asked
    with pytest.raises(Exception, match="HTTP status 404 for http://s/p9"):
        sitemap.load_site(spark, "http://s/root", prefixes=["http://s/"], policy=policy, ignore_errors=False).collect()
    assert sitemap.load_site(spark, "http://s/none", policy=policy).count() == 0


def test_listed_urls_are_loaded_from_the_network(spark, tmp_path):
    policy = fetch.Policy(get=site_get({"http://s/p1": BODY}, str(tmp_path / "log")), browser=no_browser)
    urls = spark.createDataFrame([("http://s/p1", "clash"), ("http://s/p1", "clash"), ("http://s/p2", "clash")], "url string, html string")
    assert [r.metadata["source"] for r in pages.load_urls(urls, policy=policy).collect()] == ["http://s/p1/"] * 2
    assert (tmp_path / "log").read_text().count("p1") == 1


# -- sink -----------------------------------------------------------------------------------------


def test_sink_takes_each_row_once(spark, tmp_path):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("line\n"), "id")).alias("text")).repartition(4)
    out, schema = f"{tmp_path}/out", "id long, text string"
    sink.save(rows, out)
    sink.save(rows.limit(0), out)
    assert sorted(map(tuple, sink.saved(spark, out, schema).collect())) == sorted(map(tuple, rows.collect()))
    sink.save(rows.where("id < 10"), out)
    assert sink.saved(spark, out, schema).count() == 1010
    sink.save(rows.where("id < 7"), out, "overwrite")
    assert sink.saved(spark, out, schema).count() == 7


def test_files_of_lost_attempts_and_failed_jobs_are_never_read(spark, tmp_path):
    import pyarrow as pa

    batch = [pa.RecordBatch.from_arrays([pa.array(['{"id": 1}', '{"id": 2}'])], names=["json"])]
    writer = sink.BatchLines(f"{tmp_path}/out", False)
    lost, done = writer.write(iter(batch)), writer.write(iter(batch))  # a task that ran twice
    assert lost.file != done.file
    writer.commit([done, None])
    assert sink.saved(spark, f"{tmp_path}/out", "id long").count() == 2
    failing = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("bad row")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="bad row"):
        sink.save(failing, f"{tmp_path}/out")
    assert sink.saved(spark, f"{tmp_path}/out", "id long").count() == 2
    stream = sink.StreamLines(f"{tmp_path}/s")
    stream.commit([stream.write(iter(batch))], 0)
    stream.commit([stream.write(iter(batch))], 0)  # the batch again, after a restart
    stream.abort([stream.write(iter(batch))], 1)
    stream.commit([stream.write(iter(batch)), None], 1)
    assert sink.saved(spark, f"{tmp_path}/s", "id long").count() == 4


# -- columns --------------------------------------------------------------------------------------

CLASHES = ["ord", "page", "there", "kind", "ssg", "dom", "nodes", "payload", "failed", "asked", "kept", "l1", "filtered", "query", "count", "copy", "cached", "markdown", "error", "fence", "key", "t"]


def clashing(spark, urls):
    table = spark.createDataFrame([(u, BODY) for u in urls], "url string, html string")
    return table.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def test_columns_of_the_caller_never_clash(spark):
    table = clashing(spark, ["http://a", "http://b"])
    plain = {r.url: r.markdown for r in checked(prune(table.select("url", "html"))).collect()}
    keep = tuple(c for c in CLASHES if c not in ("cached", "markdown", "error"))
    for r in checked(prune(table, keep=keep)).collect():
        assert r.markdown == plain[r.url] and all(r[c] == f"own {c}" for c in keep)
    for name in ("markdown", "error", "meta"):
        with pytest.raises(ValueError, match="cannot be kept"):
            prune(table, keep=(name,))
    urls = pages.url_list(spark, ["http://b", "http://a", "http://b"])
    for strict in (True, False):
        got = pages.retrieve(table, urls, "", ignore_errors=strict).collect()
        assert [(r.ord, r.metadata["source"]) for r in got] == [(0, "http://b"), (1, "http://a"), (2, "http://b")]
        assert pages.load_batch(table, urls, ignore_errors=strict).count() == 3
    asked = spark.createDataFrame([("http://a", None), ("http://a", ""), ("http://b", "words")], "url string, query string")
    done = prune_requests(table, asked).collect()
    assert sorted((r.url, r.cached) for r in done) == [("http://a", False), ("http://a", True), ("http://b", False)]
    assert all((r.parse_ms == 0) == r.cached for r in done)
    with pytest.raises(Exception, match="No such page"):
        pages.load_batch(table, pages.url_list(spark, ["http://c"]), ignore_errors=False).collect()


def test_request_logs_of_any_column_names(spark):
    for key, order in (("t", "key"), ("seq", "t"), ("at", "hits"), ("a b", "c`d".replace("`", ""))):
        log = spark.createDataFrame([("x", 1, 0.0), ("x", 2, 10.0)], f"`{key}` string, `{order}` long, ts double")
        got = requests.ttl_hits(log, key, F.timestamp_seconds("ts"), 30.0, order)
        assert got.columns == [key, order, "hit"] and sorted(r.hit for r in got.collect()) == [False, True]
    with pytest.raises(ValueError):
        requests.ttl_hits(log, "hit", F.timestamp_seconds("ts"))


def test_times_are_measured(spark):
    table = spark.createDataFrame([("u", BODY, 12.5), ("v", BODY, None)], "url string, html string, fetch_ms double")
    rows = {r.url: r for r in prune(table).collect()}
    assert rows["u"].fetch_ms == 12.5 and rows["v"].fetch_ms == 0 and rows["u"].parse_ms > 0


def test_text_for_people_is_the_same_from_columns(spark):
    table = spark.createDataFrame([("http://a", "<title>T</title><meta name='author' content='A'>" + BODY, 3.0), ("http://b", BODY, 0.0)], "url string, html string, fetch_ms double")
    for query in ("", "paragraph nowhere"):
        rows = checked(prune(table, query, budget=1)).withColumn("parse_ms", F.lit(1234.0))
        want = {r.url: pages.human(r.asDict(recursive=True)) for r in rows.collect()}
        assert {r.url: r.text for r in pages.human_text(rows).collect()} == want
