"""Quality rules as a bitmask ledger, in DataFrame expressions only.

``build_ledger`` evaluates every rule once per document and stores one failure bit for each with
the measurements behind it.  Policies are versioned sets of rules, so applying another policy, or
asking what one rule removes, reads the ledger's bits and never the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A rule's failure condition over the measurements, as SQL, and its bit in the ledger."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", 2, "n_symbols > n_words"),
    Rule("repeated_lines", 3, "n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines"),
    Rule("short_words", 4, "n_words > 0 AND word_chars < 2 * n_words"),
    Rule("long_words", 5, "word_chars > 20 * n_words"),
    # the published limit of one symbol in ten words; what is labelled good lies far below, bad far above
    Rule("symbol_share", 6, "10 * n_symbols > n_words"),
)
BASE = ("few_words", "repeated_windows")
#: Policy version -> names of the rules that reject a document.
POLICIES = {"base": BASE, "2": tuple(r.name for r in RULES if r.bit < 6), "3": tuple(r.name for r in RULES)}


def mask(names: tuple[str, ...] | list[str]) -> int:
    """The bitmask of some rules; an unknown name is an error."""
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[n] for n in set(names))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column, width: int) -> Column:
    """Words inside windows (an array of hashes by position) that occur twice or more."""
    sorted_pairs = F.sort_array(F.arrays_zip(windows.alias("h"), F.sequence(F.lit(0), F.size(windows) - 1).alias("i")))

    def starts(pairs: Column) -> Column:
        def twice(k: Column) -> Column:
            here = F.get(pairs, k)["h"]
            return (F.coalesce(F.get(pairs, k - 1)["h"] == here, F.lit(False))) | (F.coalesce(F.get(pairs, k + 1)["h"] == here, F.lit(False)))

        # the pairs keep their order when each is flagged with its neighbours
        return F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(pairs) - 1), twice), lambda k: F.get(pairs, k)["i"]))

    found = _let(sorted_pairs, starts)
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    return F.aggregate(
        found,
        zero,
        lambda acc, x: F.struct((acc["total"] + x + width - F.greatest(x, acc["end"])).alias("total"), (x + width).alias("end")),
        lambda acc: acc["total"],
    )


def _measured(rows: DataFrame) -> DataFrame:
    """``rows`` (row, text) with text replaced by the measurements."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = rows.select("row", text.alias("text")).select("row", "text", F.array_remove(F.split("text", SPACES), "").alias("w"))
    n = F.size("w")
    windows = F.transform(F.arrays_zip(F.slice("w", 1, n - 2), F.slice("w", 2, n - 2), F.slice("w", 3, n - 2)), lambda z: F.xxhash64(z["0"], z["1"], z["2"]))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE))
    step = step.select(
        "row",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    return step.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), F.lit(0).cast("long")).otherwise(_covered(F.col("h"), 3)).alias("n_repeat_words"),
    )


def _with_bits(measured: DataFrame) -> DataFrame:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failure_bits", bits)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements) of every row; reads doc_id and text alone."""
    return _measured(docs.select(F.col("doc_id").alias("row"), "text")).withColumnRenamed("row", "doc_id")


def build_ledger(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, the measurements and ``failure_bits``.

    Null text counts as empty: no words, so it fails ``few_words``.  Null doc_ids and repeated rows
    are kept; other columns are not read; an empty table gives an empty ledger.
    """
    return _with_bits(measure(docs)).select("doc_id", *MEASURES, "failure_bits")


def rejected(policy: str) -> Column:
    """Whether a ledger row fails any rule of the policy version."""
    return F.col("failure_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def apply_policy(ledger: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``kept`` by a policy version."""
    return ledger.withColumn("kept", ~rejected(policy))


def keep_good(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of ``docs`` that the policy version keeps, with all their columns, in one pass."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    # the partition number is not deterministic, so the filter stays above the measurements; pushed
    # below them it would compute each as often as the rules mention it
    fenced = _measured(whole).withColumn("fence", F.spark_partition_id())
    return _with_bits(fenced).where(~rejected(policy) & (F.col("fence") >= 0)).select("row.*")


def ablations(ledger: DataFrame, policy: str) -> DataFrame:
    """(rule, failed, only): documents that fail each of the policy's rules, and those that this
    rule alone removes, so that dropping it would keep them.  One pass, pre-aggregated by bits."""
    wanted = F.lit(mask(POLICIES[policy])).cast("long")
    groups = ledger.select(F.col("failure_bits").bitwiseAND(wanted).alias("bits")).groupBy("bits").count()
    names = [r for r in RULES if r.name in POLICIES[policy]]
    rules = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in names]))
    rows = groups.select("bits", "count", rules.alias("r")).select("bits", "count", "r.rule", "r.bit")
    failed = F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("count")).otherwise(0)
    only = F.when(F.col("bits") == F.col("bit"), F.col("count")).otherwise(0)
    return rows.groupBy("rule").agg(F.sum(failed).alias("failed"), F.sum(only).alias("only"))


def error_rates(ledger: DataFrame, labels: DataFrame) -> DataFrame:
    """(policy, good, good_rejected, bad, bad_kept): how every policy version judges the documents
    that ``labels`` (doc_id, quality: 1 good, 0 bad) names; others, and null labels, do not count."""
    known = ledger.select("doc_id", "failure_bits").join(labels.select("doc_id", "quality"), "doc_id")
    groups = known.groupBy("quality", "failure_bits").count()
    masks = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(mask(names)).cast("long").alias("mask")) for p, names in POLICIES.items()]))
    rows = groups.select("quality", "failure_bits", "count", masks.alias("p")).withColumn("rejected", F.col("failure_bits").bitwiseAND(F.col("p.mask")) != 0)
    total = lambda which: F.coalesce(F.sum(F.when(which, F.col("count"))), F.lit(0))
    good, bad, out = F.col("quality") == 1, F.col("quality") == 0, F.col("rejected")
    sums = {"good": good, "good_rejected": good & out, "bad": bad, "bad_kept": bad & ~out}
    return rows.groupBy(F.col("p.policy").alias("policy")).agg(*[total(c).alias(n) for n, c in sums.items()])


QUERY_POLICY = "3"


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    return ablations(build_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), QUERY_POLICY)


def quality_errors(spark, sf_dir: str) -> DataFrame:
    ledger = build_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return error_rates(ledger, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    ledger = build_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    judged = apply_policy(ledger, QUERY_POLICY).withColumn("base_failed", rejected("base"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failure_bits")


_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
#: DuckDB: the ledger of a relation ``source`` with columns rid (unique), doc_id and text.
LEDGER_SQL = rf"""
words AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{NOT_SPACE}')) AS lines FROM source),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM words, unnest(range(1, len(w) - 1)) u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM windows) WHERE c > 1),
inside AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY rid),
measured AS (SELECT words.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '{SYMBOLS}'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM words LEFT JOIN inside ON words.rid = inside.rid),
ledger AS (SELECT *, ({_BITS})::BIGINT AS failure_bits FROM measured)"""
OP9_SQL = f"""
WITH source AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, failure_bits = 0 AS kept, failure_bits
FROM ledger
"""
_RULES = ", ".join(f"('{r.name}', {1 << r.bit})" for r in RULES)
ABLATIONS_SQL = f"""
WITH source AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {LEDGER_SQL}
SELECT rule, count_if(failure_bits & bit <> 0)::BIGINT AS failed, count_if(failure_bits = bit)::BIGINT AS "only"
FROM ledger, (VALUES {_RULES}) r(rule, bit) GROUP BY rule
"""
_MASKS = ", ".join(f"('{p}', {mask(names)})" for p, names in POLICIES.items())
ERRORS_SQL = f"""
WITH source AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {LEDGER_SQL}
SELECT policy, count_if(quality = 1)::BIGINT AS good, count_if(quality = 1 AND failure_bits & mask <> 0)::BIGINT AS good_rejected,
  count_if(quality = 0)::BIGINT AS bad, count_if(quality = 0 AND failure_bits & mask = 0)::BIGINT AS bad_kept
FROM ledger JOIN labels USING (doc_id), (VALUES {_MASKS}) p(policy, mask) GROUP BY policy
"""
