import random

import numpy as np
import pyarrow as pa

from siftwell.llm import decontaminate as d


def normal(text):
    return d.normalise(d.points_of(text or ""))[0].tobytes().decode("utf-32-le")


def sellers(item, text):
    """Fewest edits between ``item`` and any region of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abcxyz é")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("abcxyz é"))
    return "".join(out)


def fixture():
    rng = random.Random(11)
    syllables = ["the", "an", "er", "tion", "is", "ou", "é", "ing", "ble", "st"]
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))
    items = [(i, prose(rng.randrange(4, 30)).capitalize() + ".") for i in range(12)] + [(90, "short one"), (91, None), (92, "  "), (93, "Ab")]
    docs = []
    for k in range(150):
        item = rng.choice(items[:12])[1]
        body = edited(rng, item, rng.choice([0, 0, 1, 2, 3, 5, 8, 12]))
        cut = body[: rng.randrange(len(body))] if rng.random() < 0.15 else body
        docs.append((k, prose(rng.randrange(0, 20)) + rng.choice([" ", "\n\n", "", "  "]) + cut.replace(" ", rng.choice([" ", "  ", "\n"])) + prose(rng.randrange(0, 20))))
    docs += [(900, None), (901, ""), (902, " SHORT  one "), (903, "a short one here"), (904, items[0][1]), (905, "ab"), (None, items[1][1])]
    return docs, items


def brute(docs, items):
    found = {}
    for doc_id, text in docs:
        for item_id, item in items:
            want = normal((item or "").strip())
            if not want:
                continue
            if len(want) < d.Q:
                if normal(text).strip() == want:
                    found[doc_id, item_id] = 0
                continue
            budget = min(int(d.RATE * len(want) + 1e-9), (len(want) - d.Q) // d.Q)
            edits = sellers(want, normal(text))
            if edits <= budget:
                found[doc_id, item_id] = edits
    return found


def test_matches_equal_brute_force(spark):
    docs, items = fixture()
    docs_df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert 40 < len(want) < len(docs) and any(want.values())
    texts = dict(docs)
    for kw in ({}, {"block_chars": 100}):
        rows = d.matches(docs_df, items_df, **kw).collect()
        got = {}
        for r in rows:
            got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
            part = normal(texts[r.doc_id][r.start : r.end])
            assert sellers(normal(dict(items)[r.item_id].strip()), part.strip() if r.item_id > 50 else part) == r.edits
        assert got == want
        kept = {r.doc_id for r in d.remove_leaks(docs_df, items_df, **kw).collect()}
        assert kept == set(texts) - {k for k, _ in want}
    assert d.matches(docs_df, items_df.limit(0)).count() == 0 and d.matches(docs_df.limit(0), items_df).count() == 0


def most_alike(items, texts):
    """Fewest edits of each item with any region of each text: all texts side by side, far apart."""
    far, gap = np.uint32(0xFFFFFFFF), 64
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    flat = np.concatenate([x for p in points for x in (p, np.full(gap, far))])
    ends = np.cumsum([len(p) + gap for p in points])
    at = np.arange(len(flat) + 1, dtype=np.int32)
    for item in items:
        row = np.zeros(len(flat) + 1, np.int32)
        for i, c in enumerate(np.frombuffer(item.encode("utf-32-le"), np.uint32), 1):
            best = row + 1
            best[1:] = np.minimum(best[1:], row[:-1] + (flat != c))
            best[0] = i
            row = np.minimum.accumulate(best - at) + at
        yield [int(row[end - len(p) - gap : end - gap + 1].min()) for p, end in zip(points, ends)]


def test_query_equals_brute_force_with_edits(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, normal(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, normal(r.text.strip())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.item_id % 4 == 0]
    want = {}
    for (item_id, item), edits in zip(items, most_alike([x for _, x in items], [t for _, t in docs])):
        budget = min(int(d.RATE * len(item) + 1e-9), (len(item) - d.Q) // d.Q)
        want |= {(doc_id, item_id): e for (doc_id, _), e in zip(docs, edits) if e <= budget}
    got = {}
    for r in d.op4_decontamination(spark, sf).where("item_id % 4 = 0").collect():
        got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
    assert want and got == want


def test_one_index_is_alive_at_a_time(spark, monkeypatch):
    docs, items = fixture()
    docs_df = spark.createDataFrame([(*x, 1, 2, 3) for x in docs], "doc_id long, text string, row int, leak_id int, own_mark int")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    alive, most, made = [0], [0], [0]
    real = spark.sparkContext.broadcast

    def broadcast(value):
        out, destroy = real(value), None
        if isinstance(value, d.Index):
            alive[0], made[0] = alive[0] + 1, made[0] + 1
            most[0] = max(most[0], alive[0])
            destroy = out.destroy
            out.destroy = lambda *a: (alive.__setitem__(0, alive[0] - 1), destroy(*a))
        return out

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    rows = d.matches(docs_df, items_df, block_chars=150)
    assert made[0] > 5 and most[0] == 1
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, d.matches(docs_df, items_df).collect()), key=str)
    many, one = (d.remove_leaks(docs_df, items_df, block_chars=n) for n in (150, 1 << 20))
    assert many.columns == docs_df.columns and sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, one.collect()), key=str)


def test_hashes_of_every_width_tell_grams_apart():
    points = d.points_of("abcabcabdé" * 5)
    for q in range(1, 20):
        grams = [points[i : i + q].tobytes() for i in range(len(points) - q + 1)]
        hashes = d.gram_hashes(points, q).tolist()
        assert len(hashes) == len(grams) and len(set(zip(grams, hashes))) == len(set(grams)) == len(set(hashes))
    assert len(d.gram_hashes(points[:3], 4)) == 0


def test_query_finds_the_items_that_documents_quote(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, normal(r.text.strip())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    quoted = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = normal(r.text)
        quoted |= {(r.doc_id, i) for i, x in items if x in text}
    rows = d.op4_decontamination(spark, sf).collect()
    assert quoted and {(r.doc_id, r.item_id) for r in rows if r.edits == 0} == quoted
    assert np.mean([r.edits == 0 for r in rows]) > 0.9


def test_a_long_line_of_one_character_stays_small():
    import tracemalloc

    item = "A title of the thing " + "-" * 60 + " and what follows it"
    index = d.build_index([(1, item), (2, "-" * 70)])
    line = "-" * 400_000
    array, ends = d.utf8_parts(pa.array([line, f"see {item} there", "nothing"]))
    tracemalloc.start()
    found = d.find_matches(index, array, ends)
    peak = tracemalloc.get_traced_memory()[1]
    assert peak < 200 << 20
    assert {(r, i) for r, i, *_ in found} == {(0, 2), (1, 1)} or {(r, i) for r, i, *_ in found} == {(0, 2), (1, 1), (1, 2)}
    spans = sorted((s, e) for r, _, s, e, *_ in found if r == 0)
    assert len(spans) >= 400_000 // 80 and all(b <= a for (_, b), (a, _) in zip(spans, spans[1:]))
