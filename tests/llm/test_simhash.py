import numpy as np
import xxhash

from pyspark.sql import functions as F

from siftwell.llm import shingles as shingles_of, simhash
from siftwell.llm.storage import scratch


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(values):
    parent = list(range(len(values)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 3:
                a_root, b_root = root(i), root(j)
                parent[max(a_root, b_root)] = min(a_root, b_root)
    return [root(i) for i in range(len(values))]


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(texts):
    """Smallest doc_id of each component of pairs that share 0.8 of their five-word shingles."""
    order = sorted(texts)
    sets, parent, holders = {d: shingles(texts[d]) for d in order}, {d: d for d in order}, {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in order:
        for other in {o for g in sets[d] for o in holders.get(g, ())} if sets[d] else {o for o in order if o < d and not sets[o]}:
            shared = len(sets[d] & sets[other])
            if shared >= 0.8 * (len(sets[d]) + len(sets[other]) - shared):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
        for g in sets[d]:
            holders.setdefault(g, []).append(d)
    return {root(d) for d in order}


def test_shingle_hashes_stand_for_shingles():
    texts = ["a b c d e f g", "A b C d E", "a b", "", "  ", "a b c d e a b c d e a b c d e", "é è a b c d"]
    got = shingles_of.shingle_hashes([t.encode() for t in texts])
    assert [len(x) for x in got] == [len(shingles(t)) for t in texts]
    by = {}
    for t, x in zip(texts, got):
        for g in shingles(t):
            by.setdefault(g, set()).update([frozenset(x.tolist())])
    assert set(got[1]) <= set(got[0]) and set(got[1]) <= set(got[5]) and not set(got[2]) & set(got[0])


def test_near_copies_are_caught_and_others_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_kept({r.doc_id: r.text for r in docs.collect()})
    assert len(want) < docs.count()
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(want)
    shuffled = docs.orderBy(F.xxhash64("doc_id")).repartition(7)
    tiny = simhash.keep_one(shuffled, radius=4, shard_rows=50, block_rows=60, block_keys=5, block_shingles=3000)
    assert sorted(r.doc_id for r in tiny.collect()) == sorted(want)


def test_fingerprint_matches_its_definition(spark):
    texts = ["One two THREE four five", "a b", "", None, " \t\n", "É é Ñ ñ x y", "same same same same " * 50]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(rows).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def fingerprint_set():
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**64, 60, dtype=np.uint64)]
    out = list(base)
    for x in base[:30]:
        for n in (1, 2, 3, 4, 5):
            y = x
            for bit in rng.choice(64, n, replace=False):
                y ^= 1 << int(bit)
            out.append(y)
    ball = base[0]
    for i in range(64):
        out.append(ball ^ (1 << i))
    return sorted(set(out))


def test_links_equal_brute_force_in_tiny_shards_and_blocks(spark):
    values = fingerprint_set()
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long").cache()
    for kw in ({}, {"shard_rows": 16, "block_rows": 64}, {"shard_rows": 50, "block_rows": 20}):
        links = simhash.fingerprint_links(fps, **kw)
        found = {r.node: r.root for r in simhash.connected(links).collect()}
        order = sorted(range(len(signed)), key=lambda i: signed[i])
        want = brute_components([values[i] for i in order])
        assert [found.get(signed[i], signed[i]) for i in order] == [signed[order[k]] for k in want]


def test_a_sample_is_small_in_all_partitions_together(spark):
    fps = spark.range(400_000).repartition(16).select((F.col("id") * 7919).alias("fp"))
    for total, bound, low, high in ((400_000, 1000, 1000, 1500), (400_000, 1 << 17, 1 << 17, 180_000)):
        assert low <= simhash.hash_share(fps, total, bound).count() <= high
    assert simhash.hash_share(fps.limit(50), 50, 1000).count() == 50 and simhash.hash_share(fps.limit(0), 0, 1000).count() == 0


def test_components_of_long_chains_and_stars(spark):
    rng = np.random.default_rng(8)
    names = rng.permutation(3000) - 1500
    pairs = [(int(names[i]), int(names[i + 1])) for i in range(900)]  # a chain in random order
    pairs += [(int(names[1000]), int(names[k])) for k in range(1001, 2000)]  # a star
    pairs += [(int(a), int(b)) for a, b in rng.choice(names[2000:], (800, 2))]
    found = {r.node: r.root for r in simhash.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    node, root = shingles_of.forest(*(np.array([p[i] for p in pairs], np.int64) for i in (0, 1)))
    assert found == dict(zip(node.tolist(), root.tolist()))
    assert simhash.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_search_within_a_shard_equals_brute_force():
    values = np.array(fingerprint_set(), np.uint64)
    found = list(simhash.search(values, values[:0], simhash.HALVES[0], 3)) + list(simhash.search(values, values[:0], simhash.HALVES[1], 3))
    left, right = (np.concatenate([x[i] for x in found]) for i in (0, 1))
    node, root = shingles_of.forest(left, right)
    want = brute_components([int(v) for v in values])
    got = dict(zip(node.tolist(), root.tolist()))
    assert [got.get(int(v), int(v)) for v in values] == [int(values[k]) for k in want]


def test_components_of_documents(spark):
    long_text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, long_text), (3, long_text.upper()), (9, None), (8, "  "), (2, "lonely words here now"), (2, "lonely words here now"), (None, long_text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(False, 2, 2), (False, 2, 2), (False, 3, 3), (False, 5, 3), (False, 8, 8), (False, 9, 8), (True, None, 3)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    docs.sort(key=lambda r: r.doc_id)
    fps = [brute_fingerprint(r.text) for r in docs]
    want = {(d.doc_id, f"{f:016x}", docs[c].doc_id) for d, f, c in zip(docs, fps, brute_components(fps))}
    assert {tuple(r) for r in simhash.op2_simhash(spark, "/root/testdata/sf0.001").collect()} == want


def edited(rng, words, edits):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"edit{rng.integers(1 << 40)}"
    return out


def kept_of(spark, texts, **kw):
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.keep_one(docs, **kw).collect())


def test_two_versions_of_many_copies_are_one_group(spark):
    """Each copy is closest to copies of its own version; only links between the versions join them."""
    rng, texts = np.random.default_rng(3), {}
    for group in range(6):
        words = [f"w{x}" for x in rng.integers(0, 5000, 400)]
        other = words[:340] + [f"v{x}" for x in rng.integers(0, 5000, 28)] + words[368:]
        for version in (words, other):
            for _ in range(60):
                texts[len(texts)] = " ".join(edited(rng, version, int(rng.integers(1, 4))))
    want = brute_kept(texts)
    assert len(want) == 6 and kept_of(spark, texts) == sorted(want)


def test_copies_with_one_part_cut_added_or_replaced_are_caught(spark):
    rng, texts, want = np.random.default_rng(4), {}, set()
    pick = lambda n: [f"w{x}" for x in np.minimum(rng.zipf(1.2, n), 30000)]
    for i in range(600):
        words = pick(int(rng.integers(60, 300)))
        n = len(words)
        at = int(rng.integers(0, n // 2))
        edits = [words[: n - n // 6], words + pick(n // 6), words[:at] + pick(n // 14) + words[at + n // 14 :], words[:at] + words[at + n // 6 :]]
        for version in (words, edits[i % 4]):
            texts[len(texts)] = " ".join(version)
    want = brute_kept(texts)
    assert len(want) < 750 and kept_of(spark, texts) == sorted(want)


def test_different_texts_with_one_fingerprint_stay(spark):
    line = " ".join(f"line{i}" for i in range(11))
    own = [" ".join(f"{name}{i}" for i in range(3000)) for name in "abc"]
    texts = {i: f"{x} " + f"{line} " * 1000 for i, x in enumerate(own)}
    texts[3] = f"{texts[0]} {line}"
    assert len({simhash.fingerprint(t.encode(), simhash.PAIR_WIDTH) for t in texts.values()}) == 1
    assert brute_kept(texts) == {0, 1, 2} and kept_of(spark, texts) == [0, 1, 2]


def test_shingle_index_in_tiny_blocks_finds_all_pairs(spark):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in range(120)]
    sets = shingles_of.shingle_hashes([" ".join(edited(rng, base, int(rng.integers(0, 6)))).encode() for _ in range(80)])
    keys = shingles_of.set_keys(sets)
    common = np.unique(np.concatenate(sets)[::7]), np.arange(len(np.unique(np.concatenate(sets)[::7])))
    alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    starts = shingles_of.prefixes(sets, common, 0.8)
    for i in range(80):
        for k in range(i):
            assert not alike(sets[i], sets[k]) or len(np.intersect1d(starts[i], starts[k]))
    docs = spark.createDataFrame([(" ".join(edited(rng, base, int(rng.integers(0, 6)))), i) for i in range(80)], "text string, mark long")
    sets = shingles_of.shingle_hashes([r.text.encode() for r in docs.collect()])
    keys = shingles_of.set_keys(sets).tolist()
    rows = [(k, k, len(x), bytes(b)) for k, x, b in zip(keys, sets, shingles_of.parities(sets))]
    classes = spark.createDataFrame(rows, "key long, root long, n long, bits binary")
    want = {tuple(sorted((keys[i], keys[k]))) for i in range(80) for k in range(i) if keys[i] != keys[k] and alike(sets[i], sets[k])}
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for most in (512, 7):
        with scratch(spark) as keep:
            links = shingles_of.proposed_links(docs, classes, 0.8, keep, most).collect()
        parent = {k: k for k in keys}
        for r in links:
            parent[root(r.a)] = root(r.b)
        assert want and all(root(a) == root(b) for a, b in want)


def test_rows_of_different_roots_meet_once_dealt(spark):
    rng = np.random.default_rng(8)
    rows = [(g, g * 1000 + i, g if rng.random() < share else g * 1000 + i) for g, share in ((1, 0.9), (2, 0.0), (3, 1.0)) for i in range(90)]
    rows += [(4, 4001, 4001), (4, 4002, 4002), (5, 5001, 5001)]
    frame = spark.createDataFrame(rows, "group long, key long, root long")
    for most in (1000, 20, 7):
        cells = {}
        for r in shingles_of.dealt(frame, F.lit(1), most).collect():
            cells.setdefault(r.cell, []).append(r)
        met = {tuple(sorted((x.key, y.key))) for c in cells.values() for i, x in enumerate(c) for y in c[:i] if x.root != y.root and (x.diagonal or x.block != y.block)}
        want = {tuple(sorted((x[1], y[1]))) for i, x in enumerate(rows) for y in rows[:i] if x[0] == y[0] and x[2] != y[2]}
        assert met == want
        assert all(r.group != 3 for c in cells.values() for r in c) and max(map(len, cells.values())) <= 6 * most
