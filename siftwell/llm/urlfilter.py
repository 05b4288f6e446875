"""URL filters: host/path rules plus a listed-URL test by blocked Bloom filter and exact join.

Everything here is DataFrame expressions.  ``listed`` may be of any size: its distinct canonical
URLs are hashed into a blocked Bloom filter (blocks of eight 64-bit lanes, one bit in each lane),
a table of one row per block.  Pages look their block up; only possible hits are joined exactly
with the list, which removes the false positives.  Filter and list are broadcast while their computed
size is at most ``broadcast_bytes``, and pages are then read once.  A larger filter is joined by
block with a shuffle; for a larger list only the possible hits are shuffled, which takes a second
read of the urls in place of a shuffle of all pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.storage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that only track where a visit came from.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
LANES, LANE_BITS = 8, 64
#: Bytes of a block's row when broadcast: its number, eight lanes and the hash table's share.
BLOCK_ROW_BYTES = 128
#: Bytes of a listed URL's row when broadcast, beside the URL itself.
LISTED_ROW_BYTES = 64

Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for null or a url without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path after the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Scheme, default port, trailing slashes, tracking parameters and fragment dropped, the other
    parameters sorted; null for null or a url without ``://``."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, tail))


def parse_rules(rules: Sequence[Rule]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule, host, path) of rules such as ``("block", "net/es/")``, longest first."""
    parsed = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        parsed.append((verdict, rule, host.translate(str.maketrans(UPPER, LOWER)), slash + path))
    return sorted(parsed, key=lambda r: (-len(r[1]), r[1], r[0]))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else null.  Rules are a short policy
    list: they become one CASE expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text, rule_host, rule_path in reversed(parse_rules(rules)):
        fits = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        fits = fits & F.startswith(path, F.lit(rule_path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _block(canonical: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(canonical), F.lit(blocks))


def _lane_bits(canonical: Column) -> list[Column]:
    """One bit for each lane, from 48 bits of a second hash."""
    second = F.xxhash64(canonical, F.lit(1))
    return [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int"))
        for i in range(LANES)
    ]


def build_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """The blocked Bloom filter of ``listed.canonical``: (block, lane0 .. lane7)."""
    bits = [b.alias(f"lane{i}") for i, b in enumerate(_lane_bits(F.col("canonical")))]
    return (
        listed.select(_block(F.col("canonical"), blocks).alias("block"), *bits)
        .groupBy("block")
        .agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])
    )


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[Rule],
    *,
    listed_verdict: str = "block",
    other_verdict: str = "allow",
    bits_per_url: int = 16,
    broadcast_bytes: int = 32 << 20,
) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url); ``listed`` has a column ``canonical``.

    Returns page_id, url, host, path, canonical, rule, listed (boolean), verdict: the fitting
    rule's verdict, else ``listed_verdict`` for a listed canonical URL, else ``other_verdict``.

    Null url or one without ``://``: empty host and path, null canonical, never listed.  Null
    page_id and repeated rows are kept as they are; other columns of ``pages`` are not read.  Empty
    strings, nulls and repeats in ``listed`` are ignored; an empty list blocks nothing.
    """
    names = cut(listed.select("canonical").where("canonical IS NOT NULL AND canonical <> ''").distinct())
    count, url_bytes = names.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canonical")), F.lit(0))).first()
    blocks = max(1, -(-count * bits_per_url // (LANES * LANE_BITS)))
    bloom = build_filter(names, blocks)
    if blocks * BLOCK_ROW_BYTES <= broadcast_bytes:
        bloom = F.broadcast(bloom)

    url = F.col("url")
    judged = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), canonical_url(url).alias("canonical"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    # pages without a canonical URL are never hits; they are spread over the blocks
    spread = F.coalesce("canonical", "url", F.col("page_id").cast("string"))
    judged = judged.select("*", rule.alias("rule"), verdict.alias("ruled"), _block(spread, blocks).alias("block"))
    hit = F.lit(True)
    for i, bit in enumerate(_lane_bits(F.col("canonical"))):
        hit = hit & (F.col(f"lane{i}").bitwiseAND(bit) != 0)
    probed = judged.join(bloom, "block", "left").withColumn("possible", F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False)))

    shape = ["page_id", "url", "host", "path", "canonical", "rule", "listed", "ruled"]
    exact = names.select(F.col("canonical").alias("name"))
    if url_bytes + count * LISTED_ROW_BYTES <= broadcast_bytes:
        key = F.when(F.col("possible"), F.col("canonical"))
        found = probed.join(F.broadcast(exact), key == F.col("name"), "left").withColumn("listed", F.col("name").isNotNull()).select(shape)
    else:
        clear = probed.where(~F.col("possible")).withColumn("listed", F.lit(False)).select(shape)
        maybe = probed.where("possible").join(exact, F.col("canonical") == F.col("name"), "left")
        found = clear.unionByName(maybe.withColumn("listed", F.col("name").isNotNull()).select(shape))
    method = F.when(F.col("listed"), listed_verdict).otherwise(other_verdict)
    return found.withColumn("verdict", F.coalesce("ruled", method)).drop("ruled")


# -- the registered query -------------------------------------------------------------------------

#: Fixed values of the query's contract.
QUERY_RULES: list[Rule] = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def respelled(pages: DataFrame) -> DataFrame:
    """The query's list: canonical URLs that the table reaches by several different spellings,
    the usual mark of crawl traps and session links."""
    return (
        pages.select(canonical_url(F.col("url")).alias("canonical"), "url")
        .where("canonical IS NOT NULL")
        .groupBy("canonical")
        .agg(F.min("url").alias("low"), F.max("url").alias("high"))
        .where("low <> high")
        .select("canonical")
    )


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, respelled(pages), QUERY_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


_TRANSLATE = f"'{UPPER}', '{LOWER}'"
OP1_SQL = rf"""
WITH split AS (
  SELECT page_id, url,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), {_TRANSLATE}) AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '^.*?://[^?#]*\?([^#]*)', 1, 's'), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS params
  FROM pages),
named AS (
  SELECT *, CASE WHEN contains(url, '://') THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical
  FROM split),
listed AS (SELECT canonical FROM named WHERE canonical IS NOT NULL GROUP BY canonical HAVING min(url) <> max(url)),
rules(verdict, rule, rhost, rpath) AS (VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
judged AS (
  SELECT n.*, (SELECT struct_pack(rule := r.rule, verdict := r.verdict) FROM rules r
    WHERE (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath) ORDER BY length(r.rule) DESC LIMIT 1) AS best,
    coalesce(n.canonical IN (SELECT canonical FROM listed), false) AS listed
  FROM named n)
SELECT page_id, host, path, best.rule AS rule,
  coalesce(best.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM judged
"""
