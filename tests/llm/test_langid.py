import zlib
from itertools import product

import numpy as np
import pytest

from siftwell.llm import langid


def enumerate_marginals(scores, transitions):
    n, k = scores.shape
    out = np.zeros((n, k))
    for path in product(range(k), repeat=n):
        weight = np.exp(sum(scores[i, x] for i, x in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:])))
        for i, x in enumerate(path):
            out[i, x] += weight
    return out / out.sum(axis=1, keepdims=True)


def test_marginals_equal_enumeration_and_recursion():
    rng = np.random.default_rng(1)
    lengths = [0, 1, 2, 7, 0, 5, 3]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores, transitions = rng.normal(size=(first[-1], 3)) * 3, rng.normal(size=(3, 3))
    got = langid.marginals(scores, first, transitions)
    for a, b in zip(first, first[1:]):
        if a < b:
            assert np.allclose(got[a:b], enumerate_marginals(scores[a:b], transitions))
    # chains over many blocks: plain recursion
    lengths = [langid.BLOCK * 4 + 3, 1, langid.BLOCK, langid.BLOCK + 1, 700]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores = rng.normal(size=(first[-1], 4)) * 20
    transitions = rng.normal(size=(4, 4)) * 2
    got = langid.marginals(scores, first, transitions)
    for a, b in zip(first, first[1:]):
        forward, backward = [scores[a]], [np.zeros(4)]
        for t in range(a + 1, b):
            forward.append(np.logaddexp.reduce(forward[-1][:, None] + transitions, axis=0) + scores[t])
        for t in range(b - 1, a, -1):
            backward.append(np.logaddexp.reduce(transitions + scores[t] + backward[-1], axis=1))
        log = np.array(forward) + np.array(backward[::-1])
        assert np.allclose(got[a:b], np.exp(log - np.logaddexp.reduce(log, axis=1)[:, None]), atol=1e-9)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return langid.train(langid.training_sample(docs.where(~langid.held_out(docs.doc_id))))


def test_held_out_accuracy_and_folds(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = langid.op5_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    tested = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out]
    assert len(tested) > 200 and np.mean(tested) > 0.98


def test_training_sees_neither_held_out_nor_unlabelled_rows(spark):
    rows = [(1, "uno dos tres", "es"), (2, "only held", "xx"), (3, None, "yy"), (4, "one two", None), (None, "null id", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = docs.where(~langid.held_out(docs.doc_id) & docs.doc_id.isNotNull())
    want = {(t, lang) for i, t, lang in rows if i and zlib.crc32(str(i).encode()) % 3 != 1 and t and lang}
    assert set(langid.training_sample(kept)) == want


def test_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat('w', id, repeat(' x', 50)) AS text", "CASE WHEN id < 10 THEN 'aa' ELSE 'bb' END AS lang")
    sample = langid.training_sample(docs, docs=60, n_words=20)
    assert sum(x == "aa" for _, x in sample) == 10 and sum(x == "bb" for _, x in sample) == 60
    assert all(len(t.split()) <= 20 for t, _ in sample)


def test_words_of_code_switched_text(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(langid.held_out(docs_id())).collect()
    by = {lang: next(r.text.split()[10:30] for r in docs if r.lang == lang and len(r.text.split()) > 100) for lang in ("de", "es")}
    got = langid.label_words(model, " ".join(by["de"] + by["es"]))
    right = [x[1] for x in got[:20]].count("de") + [x[1] for x in got[20:]].count("es")
    assert len(got) == 40 and right > 35


def docs_id():
    from pyspark.sql import functions as F

    return F.col("doc_id")


def test_odd_rows(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, " 12 + 3\n", "x"), (4, "—!?", "x"), (None, "the thing of the and that", "x"), (5, "the thing " * 20000, "x"), (5, "the", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score) for r in langid.predict(docs, model).collect()), key=str)
    assert [x[:2] for x in got] == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (5, "en")]
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.train([])
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_copies_of_a_text_crowd_no_language_out(spark):
    rows = [("one text again and again", "aa")] * 5000 + [(f"text {i} of many", lang) for lang in ("bb", "cc") for i in range(500)]
    sample = langid.training_sample(spark.createDataFrame(rows, "text string, lang string"))
    assert sample.count(("one text again and again", "aa")) == 1 and len(sample) == len(set(sample)) == 601
    assert [sum(x == lang for _, x in sample) for lang in ("aa", "bb", "cc")] == [1, 300, 300]


def test_predictions_of_rows_equal_enumeration(spark, model):
    """Score and language of whole rows from the model's weights alone, all paths enumerated."""
    texts = ["the house of words", "die Häuser und", "la maison", "x", "42 -", None, "el perro y the dog"]
    got = [(r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()]
    for text, (lang, score) in zip(texts, got):
        w = langid.words_of(*langid.buffer_of([text]))
        if not w.first[-1] or not langid.has_letter(text):
            assert (lang, score) == ("und", 0.0)
            continue
        mean = enumerate_marginals(model.emissions(w), model.transitions).mean(axis=0)
        assert lang == model.languages[int(mean.argmax())] and abs(score - mean.max()) < 1e-6
