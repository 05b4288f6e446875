"""Failed pages are told by their nodes, without Markdown; white space is looked for at the ends of texts."""

import json
import random
import time

from pyspark.sql import functions as F

from siftwell.functions.text import SPACE, collapse, single_spaces, strip
from siftwell.operators import report
from siftwell.plans.prune import prune

SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def odd_pages():
    rng = random.Random(5)
    payload = {"props": {"pageProps": {"content": [["$", "p", None, {"children": "\ud800 " * 60}]]}}}
    short = json.dumps({"props": {"pageProps": {"content": ["few"]}}})
    heads = ["", f'<script id="__NEXT_DATA__">{json.dumps(payload)}</script>', f'<script id="__NEXT_DATA__">{short}</script>']
    parts = [
        "<h1>ab</h1>", "<h2>abc</h2>", "<h3>needle</h3>", "<p>short</p>", "<p>A needle in words enough</p>", "<p>Skip to content</p>", "<table><tr><td> </td></tr></table>",
        "<table><tr><td>x</td></tr></table>", "<form><h2>H1</h2><p>" + "words " * 90 + "</p><h3>H2</h3><p>" + "needle " * 90 + "</p></form>", "<pre>　\x1c\n</pre>", "<p> \x85&nbsp;</p>", "",
        "<form><div>" + "bare words " * 30 + "</div></form>", "<nav><p>away with these words</p></nav>", "<article></article>",
    ]
    pages = [f"<head>{rng.choice(heads)}</head><body>{''.join(rng.sample(parts, rng.choice([0, 1, 2, 9])))}</body>" for _ in range(300)]
    return [(str(k), html, rng.choice(["", "needle", "words abc"])) for k, html in enumerate([*pages, None, "", " ", *parts])]


def test_pages_fail_whose_markdown_is_blank(spark):
    table = spark.createDataFrame(odd_pages(), "url string, html string, q string")
    rows = prune(table, F.col("q"), budget=1).collect()
    blank = {r.url for r in rows if not r.markdown.strip()}
    assert {r.url for r in rows if r.error is not None} == blank and 40 < len(blank) < len(rows) - 40
    assert any((r.bm25_confidence or 0) > 0 for r in rows) and any(r.render_type == "SSG" for r in rows)
    assert {r.url for r in report.errors(prune(table, F.col("q"), budget=1)).collect()} == blank


def test_errors_do_not_make_markdown(spark):
    table = spark.createDataFrame([("a", "<p>Words</p>", "x")], "url string, html string, q string")
    plan = lambda frame: frame._jdf.queryExecution().executedPlan().toString()
    whole, errors = plan(prune(table, F.col("q"))), plan(report.errors(prune(table, F.col("q"))))
    assert "```" in whole and "ArrowEvalPython" in errors and "```" not in errors


def test_white_space_of_odd_texts(spark):
    rng = random.Random(3)
    some = ["a", "~", "!", "é", "ß", "я", "中", "\U0001f600", "\x7f", "\x84", "​", "﻿", " ", " ", "\n", *SPACES]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(12))) for _ in range(4000)] + ["", " ", "  ", "\n", *SPACES, *(f"{s}x{s}" for s in SPACES), None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", f"{SPACE}+", " ")
    for t, stripped, single, collapsed, before in frame.select("t", strip(F.col("t")), single_spaces(F.col("t")), collapse(F.col("t")), old).collect():
        assert stripped == (t and t.strip()) and single == before
        assert collapsed == (t and " ".join(t.split()))


def test_texts_without_white_space_at_their_ends_are_not_searched(spark):
    frame = spark.range(64).select(F.concat(F.repeat(F.lit("words of a text "), 20_000), F.lit("end")).alias("t")).cache()
    frame.count()

    def seconds(c):
        began = time.perf_counter()
        frame.select(F.length(c)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    searched, stripped = ([seconds(c) for _ in range(3)] for c in (F.regexp_replace("t", f"^{SPACE}+|{SPACE}+$", ""), strip(F.col("t"))))
    assert 3 * min(stripped) < min(searched)
