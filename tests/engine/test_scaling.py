"""Work inside one page grows with the page, not with its square, and results stay those of plain models."""

import random
import time

import pytest
from pyspark.sql import functions as F

from siftwell import queries
from siftwell.functions.html import page, parse
from siftwell.operators import bm25, extract
from siftwell.plans.prune import checked, parsed, prune

TABLES = "array<struct<tag:string,text:string,cells:array<string>,is_header:boolean>>"


def model_rows(html):
    """Rows of the tables that a walk of the body meets, every cell's text on its own."""
    tree = parse(html)
    out, until = [], -1
    for table in tree.elements:
        if table.tag != "table" or table.pre <= until:
            continue
        until = table.end
        for tr in tree.below(table):
            if tr.tag == "tr":
                found = [c for c in tree.below(tr) if c.tag in ("td", "th")]
                cells = [tree.text(c) for c in found]
                if any(cells):
                    out.append((" | ".join(cells), cells, tr.parent.tag == "thead" or any(c.tag == "th" for c in found)))
    return out


def random_table(rng):
    words, out = ["a", "b c", " ", "", "long words", "&amp;", "<b>x</b>", "<script>no</script>"], []
    for _ in range(rng.randrange(1, 40)):
        tag = rng.choice(["table", "tr", "tr", "td", "td", "td", "th", "thead", "div"])
        out.append(f"<{tag}>" + rng.choice(words) + (f"</{tag}>" if rng.random() < 0.5 else ""))
        if rng.random() < 0.2:
            out.append(f"</{rng.choice(['table', 'tr', 'tr', 'td', 'td', 'td', 'td', 'thead'])}>")
    return "<body><table>" + "".join(out) + "</body>"


def test_rows_of_any_nesting_equal_the_model(spark):
    rng = random.Random(11)
    cases = ["<body><table><tr><th>A<th>B<tr><td>1<td>2</table><table><tr><td>3</td><td> </td></tr><tr><td></td></tr></table></body>"]
    cases += [random_table(rng) for _ in range(400)]
    rows = parsed(spark.createDataFrame(list(enumerate(cases)), "i int, html string")).select("i", extract.l1_nodes(F.col("dom.elements")).alias("n")).collect()
    for r in rows:
        got = [(n.text, n.cells, n.is_header) for n in r.n if n.tag == "table_row"]
        assert got == model_rows(cases[r.i]), cases[r.i]
    assert sum(len(r.n) for r in rows) > 250


def parse_cost(html):
    began = time.perf_counter()
    found = page(html)
    took = time.perf_counter() - began
    index = found["elements"][0]["tables"]
    return took, sum(map(len, index["strings"])) + 8 * (len(index["cells"]) + len(index["rows"]))


@pytest.mark.parametrize("row", ["<tr><td>words of a cell</td>", "<tr><td>words of a cell", "<table><tr><td>deep table cell"])
def test_a_megabyte_of_unclosed_rows_is_parsed_in_proportion(row):
    small, large = ("<body><table>" + row * (size // len(row)) for size in (1 << 17, 1 << 20))
    (seconds, space), (more_seconds, more_space) = parse_cost(small), parse_cost(large)
    assert more_space < 8.1 * space and more_space <= 2 * len(large)
    assert more_seconds < 24 * max(seconds, 0.05)


def test_pages_whose_rows_cannot_be_held_fail_alone(spark):
    nested = "<body><p>A paragraph before the table</p><table>" + "<tr><td>words of a cell" * 40_000
    closed = "<body><table>" + "<tr><td>words of a cell</td></tr>" * 2_000
    table = spark.createDataFrame([("bad", nested), ("good", closed)], "url string, html string")
    rows = {r.url: r for r in prune(table).collect()}
    assert rows["bad"].error == "Table rows that are never closed hold too much text: bad" and rows["good"].error is None
    assert rows["good"].markdown.count("words of a cell") == 2_000
    assert [r.url for r in checked(prune(table)).collect()] == ["good"]


def seconds(frame):
    began = time.perf_counter()
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_void_tags_and_their_end_tags_take_linear_time():
    took = []
    for n in (10_000, 80_000):
        began = time.perf_counter()
        page("<p>x<br>" * n + "</p></br>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0]


def test_distinct_texts_take_n_log_n(spark):
    node = "named_struct('pos', 0, 'tag', 'p', 'text', concat('a paragraph that comes to about its own number ', {}), 'depth', 1, 'code_lang', cast(null AS string), 'cells', cast(null AS array<string>), 'is_header', false)"

    def nodes(n, text="x"):
        return spark.range(1).select(F.expr(f"transform(sequence(1, {n}), x -> {node.format(text)})").alias("n"))

    firsts = lambda df: df.select(extract._firsts(F.col("n")).alias("n"))
    assert firsts(nodes(1000, "x % 10")).select(F.transform("n", lambda n: n["text"]).alias("t")).first().t == [f"a paragraph that comes to about its own number {k % 10}" for k in range(1, 11)]
    seconds(firsts(nodes(1000)))
    small, large = seconds(firsts(nodes(20_000))), seconds(firsts(nodes(160_000)))
    assert large < 24 * max(small, 0.2)


def test_scores_read_words_once_whatever_the_number_of_terms(spark):
    corpus = "transform(sequence(1, 200), s -> transform(sequence(1, 1500), w -> concat('w', (s * 31 + w * 17) % 9973)))"
    frame = spark.range(2).select(F.expr(corpus).alias("c"))

    def cost(terms):
        return seconds(frame.select(bm25.bm25_plus(F.col("c"), F.array(*[F.lit(f"w{k * 37}") for k in range(terms)]))))

    cost(2)
    few, many = min(cost(3), cost(3)), min(cost(48), cost(48))
    assert many < 6 * few


def test_nodes_of_tables_that_no_array_holds_come_row_by_row(spark, tmp_path):
    """Table rows never closed, whose texts come to 137 M characters: all of them are there."""
    n, cell = 2_000, "words of a cell in é row, " + "x" * 40
    html = "<body><p>A paragraph before the table</p><table>" + f"<tr><td>{cell}</td>" * n + "</table><p>A paragraph after it</p></body>"
    spark.createDataFrame([(7, "u", html), (8, "v", "<body><p>Another page of one text</p></body>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert (n + 1) * n // 2 * (len(cell) + 3) > extract.MAX_TABLE_CHARS
    found = queries.QUERIES["l1_nodes"](spark, str(tmp_path)).select("page_id", "pos", "tag", F.length("text").alias("chars"), F.xxhash64("text").alias("h")).orderBy("page_id", "pos").collect()
    assert [(r.page_id, r.pos, r.tag) for r in found] == [(7, 0, "p"), *((7, k + 1, "table_row") for k in range(n)), (7, n + 1, "p"), (8, 0, "p")]
    assert [r.chars for r in found[1:-2]] == [(n - k) * len(cell) + (n - k - 1) * 3 for k in range(n)]
    assert found[n].h == spark.range(1).select(F.xxhash64(F.lit(cell))).first()[0]


def test_rows_made_one_by_one_equal_the_model(spark, monkeypatch):
    rng = random.Random(12)
    cases = ["<body><p>A text of its own</p><table><tr><th>Ä<th>B<tr><td>1<td>2</table><table><tr><td>3</td><td> </td></tr><tr><td></td></tr></table></body>"]
    cases += [random_table(rng) for _ in range(200)]
    table = parsed(spark.createDataFrame(list(enumerate(cases)), "tables int, html string"))
    whole = table.select("tables", F.inline(extract.l1_nodes(F.col("dom.elements")))).collect()
    monkeypatch.setattr(extract, "MAX_TABLE_CHARS", 20)
    rows = extract.node_rows(table, "tables")
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, whole)) and len({r.tables for r in whole}) < len(cases)
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    for k in range(len(cases)):
        got = [(r.text, r.cells, r.is_header) for r in whole if r.tables == k and r.tag == "table_row"]
        assert got == model_rows(cases[k])
    sizes = table.select(F.explode(F.get("dom.elements", F.lit(0))["tables"]["rows"]).alias("r")).select("r.bytes")
    assert sorted(r.bytes for r in sizes.collect()) == sorted(len(r[0].encode()) for c in cases for r in every_row(c))
    monkeypatch.setattr(extract, "MAX_ROW_BYTES", 40)
    with pytest.raises(Exception, match="more text than a string can hold"):
        extract.node_rows(table, "tables").collect()


def every_row(html):
    tree = parse(html)
    rows = [[tree.text(c) for c in tree.below(tr) if c.tag in ("td", "th")] for tr in tree.elements if tr.tag == "tr"]
    return [(" | ".join(cells),) for cells in rows if any(cells)] if any(e.tag == "table" for e in tree.elements) else []
