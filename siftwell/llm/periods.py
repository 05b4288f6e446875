"""Periodic runs in word sequences by block matching.

A run is a stretch of words with smallest period q (words q apart are the same), at least ``LEAST``
words and ``TIMES`` periods long, that no neighbouring word extends.  Cut the document into aligned
blocks of B words, B a power of two.  A run of a period from B to 2 B - 1 has at least 2 B words that
recur q later, so one aligned block lies among them and occurs again q words on; for the smallest B
the least length gives the same for all periods below 2 B.  For each B an Aho-Corasick automaton
over word numbers holds the aligned blocks and reads the document around them; an occurrence at a distance that
fits B is a seed, and is extended word by word both ways.

A block of B words inside a run of period p <= B recurs there at multiples of p alone, and extending
that gives the same run again.  Such seeds are passed over, which keeps the work in proportion where
a text repeats a word or a line all through.  A block can recur within 2 B words only if each of its
words does; others stay out of the automaton, and documents without any need no search.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.arrowtext import bounded, utf8_values

#: Words of the smallest block; least words of a run; least periods of a run.
BLOCK, LEAST, TIMES = 8, 24, 3
SPACES = r"[\x20\x09-\x0D]+"
Run = tuple[int, int, int]


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, equal ones alike."""
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def next_distance(ids: np.ndarray) -> np.ndarray:
    """How far on each word occurs again; the sequence's length where it does not."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids))
    same = ids[order][1:] == ids[order][:-1]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def furthest(runs: list[Run], starts: np.ndarray) -> np.ndarray:
    """The largest end of a run that starts no later than each of ``starts``; -1 if none does."""
    if not runs:
        return np.full(len(starts), -1)
    known = np.array(sorted(runs))
    ends = np.maximum.accumulate(known[:, 0] + known[:, 1])
    at = np.searchsorted(known[:, 0], starts, side="right") - 1
    return np.where(at >= 0, ends[at], -1)


def recurring(ids: np.ndarray, again: np.ndarray, size: int, runs: list[Run]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, distances) of aligned blocks of ``size`` words that occur again at a distance below
    2 * size, and at least ``size`` but for the smallest size, outside of ``runs``."""
    count = len(ids) // size
    known = furthest(runs, np.arange(count) * size)
    # a block's places end within 3 * size words; where a run reaches as far, all are inside it
    reach = np.minimum(np.arange(count) * size + 3 * size, len(ids))
    some = np.flatnonzero((again[: count * size].reshape(-1, size).max(axis=1) < 2 * size) & (known < reach))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    first = [-1] * count  # equal blocks have the number of the first
    for b in some.tolist():
        key = tuple(ids[b * size : (b + 1) * size].tolist())
        first[b] = automaton.get(key, -1)
        if first[b] < 0:
            automaton.add_word(key, b)
            first[b] = b
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton.make_automaton()
    least, starts, distances = (1 if size == BLOCK else size), [], []
    gaps = np.flatnonzero(np.diff(some) > 3) + 1
    for part in np.split(some, gaps):
        low, high = int(part[0]) * size, int(reach[part[-1]])
        for end, block in automaton.iter(tuple(ids[low:high].tolist())):
            at = low + end - size + 1
            for b in range(max(0, at // size - 1), (at - least) // size + 1):
                if first[b] == block and at - b * size < 2 * size and known[b] < at + size:
                    starts.append(b * size)
                    distances.append(at - b * size)
    return np.array(starts, np.int64), np.array(distances, np.int64)


def alike(ids: np.ndarray, at: int, distance: int, forward: bool) -> int:
    """How many words on from ``at`` (or back from before it) equal those ``distance`` later."""
    done, step = 0, 64
    while True:
        k = min(step, len(ids) - distance - at - done if forward else at - done)
        low = at + done if forward else at - done - k
        differ = np.flatnonzero(ids[low : low + k] != ids[low + distance : low + distance + k])
        if len(differ):
            return done + int(differ[0] if forward else k - 1 - differ[-1])
        done += k
        if k < step:
            return done
        step *= 2


def word_runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of every run of a sequence of numbers, by start, then period."""
    found: list[Run] = []
    again, size = next_distance(ids), BLOCK
    while max(LEAST, TIMES * size) <= len(ids):
        blocks, distances = recurring(ids, again, size, found)
        own: list[Run] = []
        for q in np.unique(distances).tolist():
            starts = np.unique(blocks[distances == q])
            starts = starts[furthest([r for r in own if q % r[2] == 0], starts) < starts + size + q]
            at = 0
            while at < len(starts):
                low = int(starts[at])
                start, end = low - alike(ids, low, q, False), low + alike(ids, low, q, True) + q
                if end - start >= max(LEAST, TIMES * q):
                    own.append((start, end - start, q))
                # the same stretch holds all blocks up to there
                at = int(np.searchsorted(starts, end - q - size, side="right"))
        found += own
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of ``docs`` (doc_id, text).

    ``runs`` has every run of the text's words (maximal stretches of characters other than 0x20 and
    0x09-0x0D) by start, then period; ``collapsed`` the words left when each run keeps its first
    period, joined by one space.  Null and blank texts have no words, no runs and empty ``collapsed``;
    null doc_ids and repeated rows stay; other columns are not read; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for text in utf8_values(batch.column("text")):
                words = text.split()
                found = word_runs(numbered(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(kept_words(words, found)))
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return bounded(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | more(best, r), r).otherwise(best))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the query's periodic ends: by h = crc32 of the decimal doc_id and
    g = floor(h / 10), where h % 10 = 0 each word from a = g % n on becomes word a + (i - a) % p of the
    n, p = 1 + floor((n - a) / (3 + g % 8)); texts changed so have their words joined by one space."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def ended(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        # the array of one struct has n, a and p computed once
        parts = F.array(F.struct(n.alias("n"), a.alias("a"), p.alias("p")))
        place = lambda i, s: F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"]))
        told = lambda s: F.transform(F.sequence(F.lit(0).cast("long"), s["n"] - 1), lambda i: F.get(w, place(i, s).cast("int")))
        return F.when(n > 0, F.array_join(F.element_at(F.transform(parts, told), 1), " "))

    words = F.array(F.array_remove(F.split("text", SPACES), ""))
    changed = F.coalesce(F.element_at(F.transform(words, ended), 1), F.lit(""))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select("doc_id", "runs", "collapsed", strongest(F.col("runs")).alias("top")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
