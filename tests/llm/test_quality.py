import re

from siftwell.llm import quality

from tests.duck import compare


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(windows) if windows.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(inside)


TEXTS = ["", None, "  \n\t", "a b", "a b c a b c a b c", "x y z\nx y z\n\n x y z\n", "é#ü $5 <b> a|b\u00a0c", "w " * 400, "p q r s p q r t p q", "q " * 3, " lead and trail "]


def test_measures_equal_brute_force(spark):
    rows = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)] + [(None, "a b", 1), (0, "", 1)], "doc_id long, text string, n_words int")
    got = [tuple(r) for r in quality.measure(rows).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute(t)) for i, t in enumerate(TEXTS)] + [(None, *brute("a b")), (0, *brute(""))], key=str)
    assert quality.build_ledger(rows.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    rows = spark.createDataFrame([(1, "good words here now " * 3), (2, "## " * 60), (3, " ".join(f"w{i}" for i in range(80))), (4, None)], "doc_id long, text string")
    ledger = quality.build_ledger(rows)
    kept = {p: {r.doc_id for r in quality.apply_policy(ledger, p).where("kept").collect()} for p in quality.POLICIES}
    assert kept == {"base": {3}, "2": {3}, "3": {3}}
    got = {r.rule: (r.failed, r.only) for r in quality.ablations(ledger, "2").collect()}
    assert got["few_words"] == (2, 1) and got["repeated_windows"] == (2, 0) and got["many_symbols"] == (1, 0)
    assert sum(quality.mask([r.name]) for r in quality.RULES) == 2 ** len(quality.RULES) - 1


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    compare(quality.op9_quality_rules(spark, sf), quality.OP9_SQL, sf)
    compare(quality.quality_ablations(spark, sf), quality.ABLATIONS_SQL, sf)
    compare(quality.quality_errors(spark, sf), quality.ERRORS_SQL, sf)


def test_error_rates_of_every_policy(spark):
    good, symbols = " ".join(f"w{i}" for i in range(80)), " ".join(f"w{i} #" if i % 3 == 0 else f"w{i}" for i in range(80))
    rows = [(1, good), (2, symbols), (3, "few"), (4, good), (5, symbols), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 9), (2, 0, 9), (3, 1, 9), (4, 0, 9), (5, None, 9), (7, 1, 9)], "doc_id long, quality int, failure_bits int")
    got = {r.policy: (r.good, r.good_rejected, r.bad, r.bad_kept) for r in quality.error_rates(quality.build_ledger(docs), labels).collect()}
    assert got == {"base": (2, 1, 2, 2), "2": (2, 1, 2, 2), "3": (2, 1, 2, 1)}
