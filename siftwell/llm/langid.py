"""Language identification by a linear-chain conditional random field over words.

Words are runs of letters of the lower-cased text.  A word's features are its hashed whole form
(lexicon), prefixes and suffixes of 1 to 3 bytes, and inner 2- and 3-grams; each has a weight per
language, and each pair of languages a transition weight, all learned by maximising the conditional
likelihood.  Since the training rows name one language per document, half of the training sequences
join stretches of documents of different languages, which teaches where text switches.

Prediction runs forward-backward over every word of every text and averages the marginals: the best
mean is the score.  Chains are cut into blocks of BLOCK words: transfer matrices of all blocks are
multiplied out together, the few messages between blocks of a text are passed in order, and then all
blocks run inside at once, which gives the same marginals as word-by-word recursion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm.arrowtext import bounded
from siftwell.llm.wordhash import mix, runs, words

UNKNOWN = "und"
FEATURE_BITS = 17
BLOCK = 32
#: Bounds of the training sample: documents of each language, and words of each.
SAMPLE_DOCS, SAMPLE_WORDS = 300, 200
SEQUENCE_WORDS, EPOCHS, BATCH, RATE, DECAY = 60, 5, 64, 0.3, 1e-4

#: Letters of the basic alphabet and every byte of other characters; all else parts words.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = False
NOT_LETTER[128:] = False
_SPACES = r"[\x20\x09-\x0D]+"


# -- features -------------------------------------------------------------------------------------


def buffer_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased UTF-8 bytes, offsets) of texts; null is empty."""
    parts = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    ends = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return np.frombuffer(b"".join(parts), np.uint8), ends


def _grams(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """An integer for the ``n`` bytes at each place."""
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = (out << np.uint64(8)) | values[at + i]
    return out


def features(array: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature number) of all features of some words."""
    values, sizes = array.astype(np.uint64), stops - starts
    number = np.arange(len(starts))
    word, key = [number], [hashes]
    for n in (1, 2, 3):
        some = np.flatnonzero(sizes >= n)
        word += [some, some]
        key += [_grams(values, starts[some], n) | np.uint64(1 << 48), _grams(values, stops[some] - n, n) | np.uint64(1 << 49)]
        if n > 1:
            room = np.maximum(sizes - n + 1, 0)
            ends = np.cumsum(room)
            at = np.repeat(starts - ends + room, room) + np.arange(ends[-1] if len(ends) else 0)
            word.append(np.repeat(number, room))
            key.append(_grams(values, at, n))
    return np.concatenate(word), (mix(np.concatenate(key)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


@dataclass
class Words:
    """The words of a buffer: distinct ones with their features, and each word's distinct number."""

    first: np.ndarray
    which: np.ndarray
    distinct: int
    word: np.ndarray
    feature: np.ndarray


def words_of(array: np.ndarray, ends: np.ndarray) -> Words:
    starts, stops, first = words(array, ends, NOT_LETTER)
    hashes = np.zeros(len(starts), np.uint64)
    for a in range(0, len(starts), 1 << 19):  # in blocks, so that power tables stay small
        some = slice(a, a + (1 << 19))
        low, high = int(starts[a]), int(stops[some][-1])
        hashes[some] = runs(array[low:high].astype(np.uint64), starts[some] - low, stops[some] - low, 0xC2B2AE3D27D4EB4F)
    own, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    word, feature = features(array, starts[at], stops[at], own)
    return Words(first, which, len(own), word, feature)


# -- the model ------------------------------------------------------------------------------------


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """Scores of every word of a buffer by language."""
        k = len(self.languages)
        by_word = np.empty((w.distinct, k))
        for i in range(k):
            by_word[:, i] = np.bincount(w.word, self.weights[w.feature, i], w.distinct)
        return by_word[w.which]


def forward_backward(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward messages of every word; the product, normalised, is its marginal.

    ``first`` has each chain's first word and the total at the end."""
    n, k = scores.shape
    if not n:
        return np.ones((0, k)), np.ones((0, k))
    step = np.exp(transitions - transitions.max())
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    lengths = np.diff(first)
    blocks_of = -(-lengths // BLOCK)
    block_first = np.concatenate([[0], np.cumsum(blocks_of)])
    chain = np.repeat(np.arange(len(lengths)), blocks_of)
    order = np.arange(len(chain)) - block_first[chain]
    begin = first[chain] + order * BLOCK
    size = np.minimum(BLOCK, first[chain + 1] - begin)
    opening = order == 0

    # transfer matrices of all blocks
    move = np.broadcast_to(np.eye(k), (len(chain), k, k)).copy()
    for t in range(BLOCK):
        live = np.flatnonzero(size > t)
        if not len(live):
            break
        m = move[live]
        stepped = m @ step
        if t == 0:
            stepped[opening[live]] = m[opening[live]]
        m = stepped * p[begin[live] + t][:, None, :]
        move[live] = m / m.max(axis=(1, 2), keepdims=True)

    # messages into and out of the blocks, chain by chain in order
    into, out = np.ones((len(chain), k)) / k, np.ones((len(chain), k))
    for j in range(1, int(blocks_of.max())):
        b = block_first[:-1][blocks_of > j] + j
        x = np.einsum("bi,bij->bj", into[b - 1], move[b - 1])
        into[b] = x / x.sum(axis=1, keepdims=True)
        b = block_first[1:][blocks_of > j] - 1 - j
        x = np.einsum("bij,bj->bi", move[b + 1], out[b + 1])
        out[b] = x / x.sum(axis=1, keepdims=True)

    alpha, beta = np.empty((n, k)), np.empty((n, k))
    a = into
    for t in range(BLOCK):
        live = np.flatnonzero(size > t)
        if not len(live):
            break
        x = a[live] @ step
        if t == 0:
            x[opening[live]] = a[live][opening[live]]
        x *= p[begin[live] + t]
        a[live] = x / x.sum(axis=1, keepdims=True)
        alpha[begin[live] + t] = a[live]
    b = out
    for t in range(BLOCK - 1, -1, -1):
        live = np.flatnonzero(size > t)
        at = begin[live] + t
        beta[at] = b[live]
        x = (p[at] * b[live]) @ step.T
        b[live] = x / x.sum(axis=1, keepdims=True)
    return alpha, beta


def marginals(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    alpha, beta = forward_backward(scores, first, transitions)
    out = alpha * beta
    return out / out.sum(axis=1, keepdims=True)


# -- training -------------------------------------------------------------------------------------


def sequences(samples: list[tuple[list[str], int]], rng: np.random.Generator) -> list[tuple[str, list[int]]]:
    """Texts of about SEQUENCE_WORDS words and each word's language: stretches of one document, and
    as many that join stretches of several."""
    out = []
    stretches = [(own[i : i + SEQUENCE_WORDS], k) for own, k in samples for i in range(0, len(own), SEQUENCE_WORDS)]
    out += [[x] for x in stretches]
    for _ in range(len(stretches)):
        parts = []
        while sum(len(w) for w, _ in parts) < SEQUENCE_WORDS:
            own, k = stretches[int(rng.integers(len(stretches)))]
            n, at = int(rng.integers(3, 25)), int(rng.integers(max(1, len(own))))
            parts.append((own[at : at + n], k))
        out.append(parts)
    out = [out[i] for i in rng.permutation(len(out))]
    found = []
    for parts in out:
        text, labels = [], []
        for words_, k in parts:
            joined = " ".join(words_)
            array, ends = buffer_of([joined])
            text.append(joined)
            labels += [k] * len(words(array, ends, NOT_LETTER)[0])
        found.append((" ".join(text), labels))
    return [x for x in found if x[1]]


def train(samples: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (text, language) pairs; without any, one that knows no language."""
    languages = sorted({lang for _, lang in samples})
    k, rng = len(languages), np.random.default_rng(seed)
    weights, transitions = np.zeros((1 << FEATURE_BITS, k), np.float32), np.zeros((k, k))
    data = sequences([(t.split(), languages.index(lang)) for t, lang in samples if t.split()], rng)
    squares, t_squares = np.full(weights.shape, 1e-3, np.float32), np.full((k, k), 1e-3)
    model = Model(languages, weights, transitions)
    prepared = []
    for i in range(0, len(data), BATCH):
        some = data[i : i + BATCH]
        w = words_of(*buffer_of([t for t, _ in some]))
        y = np.array([x for _, labels in some for x in labels])
        prepared.append((w, y))
    for _ in range(EPOCHS):
        for w, y in prepared:
            scores = model.emissions(w)
            alpha, beta = forward_backward(scores, w.first, transitions)
            q = alpha * beta
            q /= q.sum(axis=1, keepdims=True)
            q[np.arange(len(y)), y] -= 1
            by_word = np.stack([np.bincount(w.which, q[:, i], w.distinct) for i in range(k)], axis=1)
            used, at = np.unique(w.feature, return_inverse=True)
            g = np.stack([np.bincount(at, by_word[w.word, i], len(used)) for i in range(k)], axis=1) / BATCH + DECAY * weights[used]
            squares[used] += g * g
            weights[used] -= RATE * g / np.sqrt(squares[used])
            later = np.ones(len(y), bool)
            later[w.first[:-1][w.first[:-1] < len(y)]] = False
            t = np.flatnonzero(later)
            p = np.exp(scores[t] - scores[t].max(axis=1, keepdims=True)) * beta[t]
            pair = alpha[t - 1][:, :, None] * np.exp(transitions - transitions.max()) * p[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            g = pair.sum(axis=0)
            np.subtract.at(g, (y[t - 1], y[t]), 1)
            g = g / BATCH + DECAY * transitions
            t_squares += g * g
            transitions -= RATE * g / np.sqrt(t_squares)
    return model


def training_sample(labelled: DataFrame, docs: int = SAMPLE_DOCS, n_words: int = SAMPLE_WORDS) -> list[tuple[str, str]]:
    """At most ``docs`` different texts of each language, chosen by hash from all of ``labelled``
    (text, lang), and of each a stretch of ``n_words`` words at a place chosen by hash.  Copies of a
    text count once, so that a text that fills a language or the corpus crowds none out."""
    rows = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    key = F.xxhash64("text", F.lit(11))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(key, 0.02).alias("n")).collect()}
    if not sizes:
        return []
    # a little more than enough of each language passes; the rest are never sorted or moved
    share: Column = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int((1 << 30) * (1.2 * docs + 8 * docs**0.5) / max(n, 1)) + 1))).otherwise(share)
    parts = F.split("text", _SPACES)
    at = F.pmod(F.xxhash64("text", F.lit(13)), F.greatest(F.lit(1), F.size(parts) - n_words)).cast("int") + 1
    picked = rows.where(F.pmod(key, F.lit(1 << 30)) < share).select("lang", key.alias("key"), F.array_join(F.slice(parts, at, n_words), " ").alias("t"))
    texts = picked.groupBy("lang", "key").agg(F.min("t").alias("t"))
    ranked = texts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("key", F.lit(1 << 30)), "key")))
    return [(r.t, r.lang) for r in ranked.where(F.col("rank") <= docs).orderBy("lang", "rank").collect()]


# -- prediction -----------------------------------------------------------------------------------



def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def judge(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    w = words_of(*buffer_of(texts))
    k = len(model.languages)
    q = marginals(model.emissions(w), w.first, model.transitions) if k else np.zeros((len(w.which), 0))
    sums = np.concatenate([np.zeros((1, k)), np.cumsum(q, axis=0)])
    lengths = np.diff(w.first)
    mean = (sums[w.first[1:]] - sums[w.first[:-1]]) / np.maximum(lengths, 1)[:, None]
    out = []
    for row, n, text in zip(mean, lengths.tolist(), texts):
        if not k or not n or not has_letter(text):
            out.append((UNKNOWN, 0.0))
        else:
            best = int(row.argmax())
            out.append((model.languages[best], float(min(1.0, max(0.0, row[best])))))
    return out


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of each word of a text that may switch languages."""
    array, ends = buffer_of([text])
    starts, stops, _ = words(array, ends, NOT_LETTER)
    w = words_of(array, ends)
    q = marginals(model.emissions(w), w.first, model.transitions)
    return [(array[a:b].tobytes().decode("utf-8", "replace"), model.languages[int(x.argmax())], float(x.max())) for a, b, x in zip(starts, stops, q)]


def predict(docs: DataFrame, model: Model, slice_chars: int = 1 << 20) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs`` (doc_id, text).

    Null text and text without a letter: ``und`` with score 0, as for a model that knows no
    language.  Texts are judged whole; null doc_ids and repeated rows are kept; other columns are
    not read; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids, done = batch.column("text").to_pylist(), batch.column("doc_id"), 0
            while done < len(texts):
                stop, size = done, 0
                while stop < len(texts) and (stop == done or size + len(texts[stop] or "") <= slice_chars):
                    size += len(texts[stop] or "")
                    stop += 1
                found = judge(shared.value, texts[done:stop])
                columns = [ids.slice(done, stop - done), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])
                done = stop

    return bounded(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the doc_id's text leaves 1 modulo 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(training_sample(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
