"""BM25+ section filter under a token budget, per page and row-local.

A page with a blank query, few sections, few tokens, or none of the query's words passes through
whole with confidence 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import let, strip, tokenize
from siftwell.operators.extract import NODE
from siftwell.operators.sections import NO_DEPTH, sections

K1, B, DELTA = 1.5, 0.75, 1.0
BUDGET, HEADING_BOOST, DEPTH_DECAY, MIN_SECTIONS = 1200, 2.5, 0.4, 2
RESULT = f"struct<nodes:array<{NODE}>,confidence:double>"


def postings(corpus: Column, terms: Column) -> Column:
    """For each token list of ``corpus`` its tokens that are ``terms``: the index that scores are
    computed from, made in one pass over the words.  Lists without any are told by hashing."""
    return F.transform(corpus, lambda d: F.when(F.arrays_overlap(d, terms), F.filter(d, lambda w: F.array_contains(terms, w))).otherwise(F.array().cast("array<string>")))


def bm25_plus(corpus: Column, terms: Column) -> Column:
    """Score of each token list of ``corpus`` for the query ``terms`` (repeats count again).  A
    known term adds its idf to every list, and a corpus without tokens scores 0.  Words are read
    once, whatever the number of terms; the rest is in proportion to the matches and lists."""

    def scores(c: Column) -> Column:
        n = F.size(c)
        average = F.aggregate(c, F.lit(0).cast("long"), lambda a, d: a + F.size(d)) / n

        def with_hits(hits: Column) -> Column:
            known = F.transform(terms, lambda q: F.struct(q.alias("term"), F.size(F.filter(hits, lambda d: F.array_contains(d, q))).alias("df")))

            def with_terms(x: Column) -> Column:
                def score(d: Column, i: Column) -> Column:
                    norm = K1 * (1 - B + B * F.size(d) / x["average"])

                    def add(a: Column, t: Column) -> Column:
                        tf = F.size(F.filter(F.get(hits, i), lambda w: w == t["term"]))
                        return a + F.when(t["df"] > 0, F.log((x["n"] + 1) / t["df"]) * (DELTA + tf * (K1 + 1) / (norm + tf))).otherwise(0.0)

                    return F.aggregate(x["known"], F.lit(0.0), add)

                return F.when(x["average"] > 0, F.transform(c, score)).otherwise(F.transform(c, lambda d: F.lit(0.0)))

            return let(F.struct(average.alias("average"), known.alias("known"), n.alias("n")), with_terms)

        return let(postings(c, F.array_distinct(terms)), with_hits)

    return let(corpus, scores)


def section_scores(secs: Column, terms: Column) -> Column:
    """Body score weighted by depth plus the boosted heading score, by section."""

    def combined(s: Column) -> Column:
        depths = F.transform(s, lambda x: F.when(x["depth"] >= NO_DEPTH, 0).otherwise(x["depth"]))
        parts = F.struct(
            bm25_plus(F.transform(s, lambda x: x["body"]), terms).alias("body"), bm25_plus(F.transform(s, lambda x: x["head"]), terms).alias("head"), depths.alias("d"),
            F.array_min(depths).alias("low"), F.array_max(depths).alias("high"),
        )

        def add(p: Column) -> Column:
            span = F.greatest(F.lit(1), p["high"] - p["low"])
            return F.transform(p["body"], lambda b, i: b * (1 - DEPTH_DECAY * ((F.get(p["d"], i) - p["low"]) / span)) + HEADING_BOOST * F.get(p["head"], i))

        return let(parts, add)

    return let(secs, combined)


def select_sections(secs: Column, scores: Column, budget: Column, min_sections: int = MIN_SECTIONS) -> Column:
    """Numbers of the sections taken by score (ties in order) until one would pass the budget, the
    first ``min_sections`` in any case."""
    order = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))

    def take(a: Column, x: Column) -> Column:
        cost = F.get(secs, x["i"])["token_count"]
        stop = a["stop"] | ((a["used"] + cost > budget) & (F.size(a["taken"]) >= min_sections))
        return F.struct(
            F.when(stop, a["used"]).otherwise(a["used"] + cost).alias("used"), F.when(stop, a["taken"]).otherwise(F.array_append(a["taken"], x["i"])).alias("taken"), stop.alias("stop"),
        )

    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"), F.lit(False).alias("stop"))
    return F.aggregate(order, zero, take, lambda a: a["taken"])


def ancestors(secs: Column) -> Column:
    """For each section, the numbers of the sections whose headings stand above it."""

    def step(a: Column, s: Column) -> Column:
        above = F.filter(a["open"], lambda o: o["level"] < s["level"])
        own = F.struct(s["level"].alias("level"), s["sec"].alias("sec"))
        opened = F.when(s["level"] <= 5, F.array_append(above, own)).otherwise(above)
        return F.struct(opened.alias("open"), F.array_append(a["out"], F.transform(above, lambda o: o["sec"])).alias("out"))

    zero = F.struct(F.array().cast("array<struct<level:int,sec:int>>").alias("open"), F.array().cast("array<array<int>>").alias("out"))
    return F.aggregate(secs, zero, step, lambda a: a["out"])


def bm25_filter(nodes: Column, query: Column, budget: int | Column = BUDGET, min_sections: int = MIN_SECTIONS) -> Column:
    """struct(nodes, confidence): the nodes of the sections that fit the query best, with the whole
    sections above them, in document order."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    whole = F.struct(nodes.alias("nodes"), F.lit(0.0).alias("confidence"))

    def gated(x: Column) -> Column:
        total = F.aggregate(x["secs"], F.lit(0).cast("long"), lambda a, s: a + s["token_count"])
        passes = (F.size(x["secs"]) <= min_sections) | (total <= limit) | (F.size(x["terms"]) == 0)

        def scored(scores: Column) -> Column:
            best = F.array_max(scores)
            above = F.flatten(F.transform(select_sections(x["secs"], scores, limit, min_sections), lambda i: F.array_append(F.get(x["above"], i), i)))
            kept = let(above, lambda k: F.flatten(F.transform(F.filter(x["secs"], lambda s: F.array_contains(k, s["sec"])), lambda s: s["nodes"])))
            return F.when(best == 0, whole).otherwise(F.struct(kept.alias("nodes"), best.alias("confidence")))

        return F.when(passes, whole).otherwise(let(section_scores(x["secs"], x["terms"]), scored))

    def prepared(s: Column) -> Column:
        return let(F.struct(s.alias("secs"), tokenize(query).alias("terms"), ancestors(s).alias("above")), gated)

    return F.when(strip(query) == "", whole).otherwise(let(sections(nodes), prepared)).cast(RESULT)
