import hashlib
import io
import random

from siftwell.llm import warc

from tests.duck import compare


def archive(n, level=3, plain=False):
    """(bytes, starts) of n response records."""
    out, starts = b"", []
    for i in range(n):
        payload = f"<p>page {i} ".encode() + random.Random(i).randbytes(300)
        data = warc.record_bytes(f"{warc.URN}{i}", f"http://x/{i} é\r\n", payload, hashlib.sha256(payload).hexdigest(), None)
        starts.append(len(out))
        out += data if plain else warc.member(data, level)
    return out, starts + [len(out)]


def ids(data):
    found = list(warc.salvage(io.BytesIO(data), len(data)))
    names = [x.headers["warc-record-id"].strip("<>").removeprefix(warc.URN) for x in found if isinstance(x, warc.Record)]
    numbers = [int(n) if n.isdigit() else None for n in names]
    covered = sorted({(x.at, x.size) for x in found})  # gaps inside have the member's
    at = 0
    for start, size in covered:  # records and gaps tile the file
        assert start == at
        at += size
    assert at == len(data)
    return numbers, [x for x in found if isinstance(x, warc.Gap)]


def test_sound_archives():
    for plain in (False, True):
        data, _ = archive(20, plain=plain)
        assert ids(data) == (list(range(20)), [])
    assert ids(b"") == ([], [])


def test_any_damage_costs_only_the_records_it_touches():
    rng = random.Random(7)
    for plain in (False, True):
        data, starts = archive(12, plain=plain)
        for _ in range(150):
            kind, at = rng.choice("flip cut drop junk zero".split()), rng.randrange(len(data))
            n = rng.randrange(1, 700)
            bad = {
                "flip": data[:at] + bytes([data[at] ^ 1 << rng.randrange(8)]) + data[at + 1 :],
                "cut": data[:at],
                "drop": data[:at] + data[at + n :],
                "junk": data[:at] + rng.randbytes(n) + data[at:],
                "zero": data[:at] + bytes(min(n, len(data) - at)) + data[at + n :],
            }[kind]
            end = {"flip": at + 1, "cut": len(data), "drop": at + n, "junk": at + 1, "zero": at + n}[kind]
            numbers, gaps = ids(bad)
            touched = {i for i in range(12) if starts[i] < end and at < starts[i + 1]}
            if kind == "junk" and at in starts:
                touched = set()
            assert set(range(12)) - touched <= set(numbers)
            if not plain and kind not in ("cut", "drop"):  # plain headers carry no checksum
                assert gaps or set(numbers) == set(range(12))


def test_mixed_members_and_large_gaps_across_windows():
    a, _ = archive(3)
    b, _ = archive(3, plain=True)
    numbers, gaps = ids(a + bytes(3 * warc.STEP + 17) + b + b"WARC/1.1\r\n" + a[10:])
    assert numbers == [0, 1, 2, 0, 1, 2, 1, 2]
    assert gaps[0].at == len(a) and gaps[0].size == 3 * warc.STEP + 17 and len(gaps) == 2


def one_member(n, damaged=(), digest=True, size=300):
    """n records in one gzip member, some with a changed byte in their payload; and their places."""
    out, starts = b"", []
    for i in range(n):
        payload = random.Random(i).randbytes(size)
        data = warc.record_bytes(f"{warc.URN}{i}", None, payload, hashlib.sha256(payload).hexdigest(), None)
        data = data if digest else data.replace(b"WARC-Block-Digest", b"WARC-Other")
        starts.append(len(out))
        out += data[:-9] + bytes([data[-9] ^ 1]) + data[-8:] if i in damaged else data
    return out, starts + [len(out)]


def test_damage_inside_a_member_costs_its_records_alone():
    data, starts = one_member(10, damaged=(7,))
    sound, _ = archive(2)
    numbers, gaps = ids(sound + warc.member(data, 3) + sound)
    assert numbers == [0, 1, 0, 1, 2, 3, 4, 5, 6, 8, 9, 0, 1]
    assert [(g.at, g.inside, g.inside_size) for g in gaps] == [(len(sound), starts[7], starts[8] - starts[7])]
    numbers, gaps = ids(warc.member(one_member(10, damaged=(0, 1, 9))[0], 3))
    assert numbers == list(range(2, 9)) and [(g.inside, g.inside_size) for g in gaps] == [(0, starts[2]), (starts[9], starts[10] - starts[9])]
    assert ids(warc.member(one_member(3, damaged=(0, 1, 2))[0], 3))[0] == []
    plain, _ = one_member(10, damaged=(7,))
    assert ids(plain)[0] == [0, 1, 2, 3, 4, 5, 6, 8, 9]


def test_cut_and_broken_members_keep_what_inflates():
    data, starts = one_member(40)
    packed, (sound, _) = warc.member(data, 6), archive(2)
    for share in (0.2, 0.5, 0.9, 0.999):
        numbers, gaps = ids(packed[: int(len(packed) * share)])
        assert numbers == list(range(len(numbers))) and 40 * share - 3 <= len(numbers) < 40 + (share > 0.99) and gaps[-1].reason == "the member is cut off"
        assert gaps[-1].inside in starts
        assert ids(packed[: int(len(packed) * share)] + sound)[0][-2:] == [0, 1]
    # a wrong checksum alone: all records have digests that hold, and the break is logged
    numbers, gaps = ids(packed[:-8] + bytes(4) + packed[-4:] + sound)
    assert numbers == [*range(40), 0, 1] and [(g.inside, g.inside_size) for g in gaps] == [(len(data), 0)]
    # without digests of their own they do not count
    bare = warc.member(one_member(5, digest=False)[0], 6)
    assert ids(bare)[0] == list(range(5)) and ids(bare[:-8] + bytes(4) + bare[-4:])[0] == []
    rng = random.Random(2)
    for _ in range(60):
        at = rng.randrange(20, len(packed))
        numbers, gaps = ids(packed[:at] + bytes([packed[at] ^ 1 << rng.randrange(8)]) + packed[at + 1 :] + sound)
        # random payloads are stored as they are: about one record a flip, unless it hits the stream itself
        assert numbers[-2:] == [0, 1] and gaps and len(numbers) >= 40 * at / len(packed) - 2


def test_large_members_are_read_through_a_window():
    data, _ = one_member(60, damaged=(30,), size=100_000)
    packed = warc.member(data, 1)
    held, real = [], warc.Inflated.fill

    def fill(self, upto):
        real(self, upto)
        held.append(len(self.data))

    warc.Inflated.fill = fill
    try:
        numbers, gaps = ids(packed)
    finally:
        warc.Inflated.fill = real
    assert numbers == [i for i in range(60) if i != 30] and len(gaps) == 1
    assert max(held) < 2_000_000 < len(data)


def test_write_and_read_back(spark):
    long = "x" * 100
    rows = [(5, "http://a", long, 1), (3, None, long, 1), (3, "http://b", long, 1), (None, "http://c", long, 1), (7, "u", "short", 1), (8, "u", "short", 1), (9, "u", None, 1), (10, "u", "é" * 50, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    for kw in ({}, {"file_bytes": 10}):
        paths = warc.write_archives(pages, warc.fresh_dir(spark, "test"), **kw)
        got = warc.read_archives(spark, paths).collect()
        assert all(r.reason is None for r in got)
        seen = sorted((r.record_id.removeprefix(warc.URN), r.record_type, r.payload_bytes, (r.refers_to or "").removeprefix(warc.URN)) for r in got)
        want = [("10", "response", 100, ""), ("3", "response", 100, ""), ("3", "response", 100, ""), ("5", "revisit", 100, "3")]
        want += [("7", "response", 5, ""), ("8", "response", 5, ""), ("9", "response", 0, ""), ("null", "response", 100, "")]
        assert [s for s in seen if s[0] != "null"] == [w for w in want if w[0] != "null"]
        assert {r.payload for r in got if r.record_type == "response"} >= {b"", b"short", long.encode(), ("é" * 50).encode()}
    assert warc.write_archives(pages.limit(0), warc.fresh_dir(spark, "test")) == []
    assert warc.read_archives(spark, []).count() == 0


def test_damaged_file_on_spark(spark, tmp_path):
    data, starts = archive(5)
    (tmp_path / "a.warc.gz").write_bytes(data[: starts[2] + 30] + b"?" + data[starts[2] + 31 :])
    rows = warc.read_archives(spark, [f"file://{tmp_path}/a.warc.gz"], with_payload=False).collect()
    assert sorted(r.record_id for r in rows if r.record_id) == [f"{warc.URN}{i}" for i in (0, 1, 3, 4)]
    assert [(r.at, r.size) for r in rows if r.reason] == [(starts[2], starts[3] - starts[2])]


def test_query_equals_sql(spark):
    compare(warc.op3_warc(spark, "/root/testdata/sf0.01"), warc.OP3_SQL, "/root/testdata/sf0.01")


def test_very_long_urls_come_back(spark, tmp_path):
    urls = ["data:text/html," + "x" * n for n in (70_000, 1_000_000)] + ["http://x/é", None]
    rows = [(i, u, f"<p>{i}</p>" * 60) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in warc.op3_warc(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]
    paths = warc.write_archives(spark.read.parquet(f"{tmp_path}/pages.parquet"), f"file://{tmp_path}/w")
    found = warc.read_archives(spark, paths).collect()
    assert {r.target_uri for r in found} == set(urls) and all(r.reason is None for r in found)
    data = b"".join(warc.record_bytes(f"{warc.URN}{i}", u, b"y" * 99, hashlib.sha256(b"y" * 99).hexdigest(), None) for i, u in enumerate(urls))
    assert ids(b"WARC/1.1\r\njunk" + data)[0] == [0, 1, 2, 3]
