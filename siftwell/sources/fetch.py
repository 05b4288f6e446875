"""Pages fetched by URL, with user agents rotated and a browser last, politely to every host.

``fetch_table`` takes the URLs from a table or a stream of any size, ``spark.read.format("webpage")``
from its options ``urls`` (one per line), ``partitions``, ``timeout``, ``rate``, ``in_flight``.  URLs are
dealt to tasks by host, so that one token bucket in one task bounds what a host is asked; a host with
more URLs than one task should take is dealt to several, with a share of the rate each.  Tasks take
their hosts in turn, keep a bounded number of requests in flight and retry what a server says is
passing trouble.  The fetcher is pluggable for tests.
"""

from __future__ import annotations

import http.client
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Sent with requests; the first at once, the others after a refusal.
USER_AGENTS = (
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
)
LANGUAGES = "en-US,en;q=0.9"
REFUSED = (403, 429)
#: Statuses of a server in passing trouble, which is asked again.
PASSING = (500, 502, 503, 504)
Get = Callable[[str, dict[str, str], float], tuple[int, str, str]]


def http_get(url: str, headers: dict[str, str], timeout: float) -> tuple[int, str, str]:
    """(status, text, final url); network trouble is an OSError."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.url
    except urllib.error.HTTPError as error:
        return error.code, "", url


def browse(url: str) -> tuple[str, str]:
    """(html, final url) by a headless browser, if one is installed."""
    try:
        from playwright.sync_api import sync_playwright
    except ImportError:
        raise RuntimeError("the page requires JavaScript rendering, and no browser is installed") from None
    with sync_playwright() as p:
        browser = p.chromium.launch()
        try:
            page = browser.new_page()
            page.goto(url, wait_until="networkidle")
            return page.content(), page.url
        finally:
            browser.close()


def fetch(url: str, timeout: float = 15.0, get: Get = http_get, browser: Callable[[str], tuple[str, str]] = browse) -> tuple[str, str]:
    """(html, final url).  A refusal (403, 429) or network trouble moves on to the next user agent
    and at last to the browser; any other error status is raised."""
    for agent in USER_AGENTS:
        try:
            status, text, final = get(url, {"User-Agent": agent, "Accept-Language": LANGUAGES}, timeout)
        except (OSError, http.client.HTTPException):
            continue
        if status in REFUSED:
            continue
        if status >= 400:
            raise RuntimeError(f"HTTP status {status} for {url}")
        return text, final
    return browser(url)


SCHEMA = "request_url string, url string, html string, fetch_error string, fetch_ms double"
ROW_TYPE = pa.schema([(c, pa.float64() if c == "fetch_ms" else pa.string()) for c in ("request_url", "url", "html", "fetch_error", "fetch_ms")])


class TokenBucket:
    """``burst`` requests at once, and ``rate`` a second from then on; a thread waits for its turn."""

    def __init__(self, rate: float, burst: int = 1, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.last, self.lock = float(burst), clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.tokens = min(float(self.burst), self.tokens + (now - self.last) * self.rate) - 1
            self.last, wait = now, max(0.0, -self.tokens / self.rate)
        if wait:
            self.sleep(wait)


@dataclass
class Policy:
    """How a task fetches: requests a second and at once for each host (no bound if ``rate`` is None),
    requests in flight in the task, how often and after how long (doubled each time) a server in
    passing trouble is asked again."""

    rate: float | None = None
    burst: int = 1
    in_flight: int = 8
    retries: int = 2
    backoff: float = 0.5
    timeout: float = 15.0
    get: Get = http_get
    browser: Callable[[str], tuple[str, str]] = browse


@dataclass
class Fetcher:
    """Rows of ``SCHEMA`` for URLs, in one task; ``share`` of the rate is this task's."""

    policy: Policy
    buckets: dict = field(default_factory=dict)

    def asked(self, share: float) -> Get:
        """``get`` that waits for the host's token before each request and asks again in passing trouble."""
        p = self.policy

        def get(url: str, headers: dict[str, str], timeout: float) -> tuple[int, str, str]:
            bucket = p.rate and self.buckets.setdefault(host(url), TokenBucket(p.rate * share, p.burst))
            for again in range(p.retries + 1):
                if bucket:
                    bucket.take()
                found = p.get(url, headers, timeout)
                if found[0] not in PASSING or again == p.retries:
                    return found
                time.sleep(p.backoff * 2**again)

        return get

    def attempt(self, url: str, share: float = 1.0) -> tuple:
        """A row; whatever goes wrong is its ``fetch_error``.  ``fetch_ms`` has the waits in it."""
        began = time.perf_counter()
        html = final = error = None
        try:
            html, final = fetch(url, self.policy.timeout, self.asked(share), self.policy.browser)
        except Exception as trouble:
            error = str(trouble) or type(trouble).__name__
        return url, final, html, error, (time.perf_counter() - began) * 1000

    def rows(self, jobs: Iterator[tuple[str, float]]) -> Iterator[tuple]:
        """Rows in the order of (url, share), ``in_flight`` of them at most asked for or held."""
        waiting: deque = deque()
        with ThreadPoolExecutor(self.policy.in_flight) as pool:
            for url, share in jobs:
                if len(waiting) == self.policy.in_flight:
                    yield waiting.popleft().result()
                waiting.append(pool.submit(self.attempt, url, share))
            while waiting:
                yield waiting.popleft().result()


def host(url: str) -> str:
    """The host and port that a URL asks, lower-cased; empty for what is no URL."""
    try:
        return urlsplit(url).netloc.rpartition("@")[2].lower()
    except ValueError:
        return ""


def host_of(url: Column) -> Column:
    """``host`` as a Column, for dealing URLs to tasks."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def dealt(urls: DataFrame, host_urls: int, partitions: int) -> DataFrame:
    """``urls`` (url) dealt to tasks by host, each host's in as few tasks as ``host_urls`` for each
    allows, with ``share``, the part of the host's rate that its task has; hosts take turns in a task."""
    named = urls.withColumn("host", host_of(F.col("url")))
    if urls.isStreaming:
        return named.withColumn("share", F.lit(1.0)).repartition(partitions, "host")
    shares = F.greatest(F.lit(1), F.ceil(F.count("*") / host_urls)).cast("long").alias("tasks")
    counted = named.join(named.groupBy("host").agg(shares), "host").withColumn("part", F.pmod(F.xxhash64("url"), "tasks"))
    turn = F.row_number().over(Window.partitionBy("host", "part").orderBy("url"))
    return counted.repartition(partitions, "host", "part").select("url", "host", turn.alias("turn"), (1 / F.col("tasks")).alias("share")).sortWithinPartitions("turn", "host")


def fetch_table(urls: DataFrame, column: str = "url", policy: Policy | None = None, *, host_urls: int = 100_000, partitions: int | None = None, **options) -> DataFrame:
    """``SCHEMA`` for each different URL of ``urls[column]``; ``options`` are those of ``Policy``.

    Nulls and empty strings are no URLs; an empty table gives no rows; other columns are not read.
    A task holds ``in_flight`` pages at most; a lost task fetches its URLs again.  ``urls`` may be a
    stream: each batch is dealt by host, repeats are fetched again, and which URLs were taken is in
    the offsets of the stream's checkpoint."""
    policy = policy or Policy(**options)
    listed = urls.select(F.col(f"`{column}`").cast("string").alias("url")).where("url <> ''")
    listed = listed if urls.isStreaming else listed.distinct()
    partitions = partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        jobs = ((u, s) for b in batches for u, s in zip(b.column("url").to_pylist(), b.column("share").to_pylist()))
        for row in Fetcher(policy).rows(jobs):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, ROW_TYPE.types)], schema=ROW_TYPE)

    return dealt(listed, host_urls, partitions).select("url", "share").mapInArrow(run, SCHEMA)


class UrlRange(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").splitlines() if u]
        self.parts = max(1, int(options.get("partitions", "10")))
        rate = options.get("rate")
        self.policy = Policy(rate=float(rate) if rate else None, timeout=float(options.get("timeout", "15")), in_flight=int(options.get("in_flight", "8")))

    def partitions(self) -> list[InputPartition]:
        """URLs by host, the largest hosts dealt first, each to the partition with the fewest."""
        hosts: dict[str, list[str]] = {}
        for url in self.urls:
            hosts.setdefault(host(url), []).append(url)
        parts: list[list[str]] = [[] for _ in range(min(self.parts, len(hosts)))] or [[]]
        for _, urls in sorted(hosts.items(), key=lambda x: -len(x[1])):
            min(parts, key=len).extend(urls)
        return [UrlRange(p) for p in parts]

    def read(self, partition: UrlRange) -> Iterator[tuple]:
        yield from Fetcher(self.policy).rows((u, 1.0) for u in partition.urls)


class PageSource(DataSource):
    """Columns request_url, url (final), html, fetch_error, fetch_ms."""

    @classmethod
    def name(cls) -> str:
        return "webpage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)
