"""The cache of results against a plain model of its rules."""

import random

import pytest
from pyspark.sql import functions as F

from siftwell.plans.cache import KEY, ResultCache, most_recent
from siftwell.plans.prune import prune_requests
from siftwell.sources import sink
from siftwell.streaming.pages import answer_stream

BODY = "<body>" + "".join(f"<p>Paragraph number {k} of page {{0}} with words enough to count</p>" for k in range(6)) + "</body>"
ASKED = "url string, query string, count int"


def table(spark, n=8):
    return spark.createDataFrame([(f"u{k}", BODY.format(k), "clash") for k in range(n)] + [("empty", "", "clash")], "url string, html string, query string")


def test_batches_follow_the_model(spark, tmp_path):
    rng, pages, ttl = random.Random(4), table(spark), 100.0
    cache, stored = ResultCache(spark, f"{tmp_path}/c", ttl=ttl, max_size=50), {}
    for batch in range(3):
        now = batch * 60.0
        asked = [(f"u{rng.randrange(8)}", rng.choice([None, "", "paragraph"]), 0) for _ in range(rng.randrange(1, 9))] + [("gone", "", 0), ("empty", "", 0)]
        got = sorted((r.url, r.query, r.cached) for r in cache.answer(pages, spark.createDataFrame(asked, ASKED), now).collect())
        want, alive = [], {k: t for k, t in stored.items() if t + ttl > now}
        for url, query, _ in asked:
            if url.startswith("u"):
                want.append((url, query or "", (url, query or "") in alive))
                alive.setdefault((url, query or ""), now)
        assert got == sorted(want)
        stored = alive
        assert {(r.url, r.query): r.stored_at for r in cache.entries().collect()} == stored
        stats = cache.stats(now + 70).first()
        assert (stats.total, stats.alive) == (len(stored), sum(t + ttl > now + 70 for t in stored.values()))
    cache.clear()
    assert cache.entries().count() == 0


def test_answers_equal_those_without_a_cache(spark, tmp_path):
    pages, cache = table(spark), ResultCache(spark, f"{tmp_path}/c")
    asked = spark.createDataFrame([("u1", "paragraph", 1), ("u1", "paragraph", 1), ("u2", None, 1)], ASKED)
    want = sorted((r.url, r.markdown, r.cached) for r in prune_requests(pages, asked).collect())
    first = cache.answer(pages, asked, 0.0).collect()
    assert sorted((r.url, r.markdown, r.cached) for r in first) == want and all((r.parse_ms == 0) == r.cached for r in first)
    again = cache.answer(pages, asked, 1.0).collect()
    assert sorted((r.url, r.markdown) for r in again) == [w[:2] for w in want] and all(r.cached and r.parse_ms == 0 for r in again)
    # pages that changed are not read while the entry lives
    changed = pages.withColumn("html", F.lit(BODY.format("new")))
    assert all("new" not in r.markdown for r in cache.answer(changed, asked, 2.0).collect())
    assert all("new" in r.markdown for r in cache.answer(changed, asked, 400.0).collect())


def test_the_last_used_stay_and_the_first_time_of_storing_counts(spark, tmp_path):
    pages, cache = table(spark), ResultCache(spark, f"{tmp_path}/c", ttl=1000.0, max_size=3)
    ask = lambda *urls: spark.createDataFrame([(u, "", 1) for u in urls], ASKED)
    cached = lambda found: {r.url: r.cached for r in found.collect()}
    cache.answer(pages, ask("u0", "u1", "u2"), 0.0)
    assert cached(cache.answer(pages, ask("u0"), 10.0)) == {"u0": True}
    cache.answer(pages, ask("u3"), 20.0)
    left = {r.url: (r.stored_at, r.used_at) for r in cache.entries().collect()}
    assert len(left) == 3 and left["u0"] == (0.0, 10.0) and left["u3"] == (20.0, 20.0)
    assert ResultCache(spark, f"{tmp_path}/off", ttl=0.0).answer(pages, ask("u0"), 0.0).first().cached is False
    assert ResultCache(spark, f"{tmp_path}/off", ttl=0.0).entries().count() == 0


def test_a_failed_job_leaves_the_version_before(spark, tmp_path):
    pages, cache = table(spark), ResultCache(spark, f"{tmp_path}/c")
    asked = spark.createDataFrame([("u1", "", 1)], ASKED)
    cache.answer(pages, asked, 0.0)
    broken = pages.withColumn("html", F.raise_error(F.lit("lost source")).cast("string"))
    with pytest.raises(Exception, match="lost source"):
        cache.answer(broken, spark.createDataFrame([("u2", "", 1)], ASKED), 1.0)
    assert [r.url for r in cache.entries().collect()] == ["u1"]
    assert cache.answer(pages, asked, 2.0).first().cached is True


@pytest.mark.parametrize("most", [0, 1, 7, 1500, 2000, 5000])
def test_eviction_is_exact_without_ranking_all(spark, most):
    rows = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("").alias("query"), (F.col("id") % 3).cast("double").alias("used_at"))
    left = most_recent(rows, most).collect()
    assert len(left) == min(most, 3000)
    order = sorted((-r.used_at, r.part, r.h) for r in rows.select("used_at", F.xxhash64(*KEY).alias("h"), F.pmod(F.xxhash64(*KEY), F.lit(1024)).alias("part")).collect())
    assert sum(r.used_at == 2.0 for r in left) == sum(o[0] == -2.0 for o in order[:most])


def test_a_stream_of_requests_is_answered_from_the_cache(spark, tmp_path):
    pages, cache = table(spark), ResultCache(spark, f"{tmp_path}/c", ttl=300.0)

    def run(asked, now):
        spark.createDataFrame(asked, "url string, query string").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("url string, query string").parquet(f"{tmp_path}/in")
        write = lambda df, number: sink.save(df.select("url", "query", "cached", F.lit(now).alias("at")), f"{tmp_path}/out")
        query = answer_stream(stream, pages, cache, write, lambda: now).option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start()
        assert query.awaitTermination(180)

    run([("u1", "paragraph")], 0.0)
    run([("u1", "paragraph"), ("u2", None)], 100.0)
    got = sink.saved(spark, f"{tmp_path}/out", "url string, query string, cached boolean, at double").collect()
    assert sorted((r.at, r.url, r.query, r.cached) for r in got) == [(0.0, "u1", "paragraph", False), (100.0, "u1", "paragraph", True), (100.0, "u2", "", False)]
