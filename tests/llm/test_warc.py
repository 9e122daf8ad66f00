"""Round trips and salvage of damaged archives."""

import gzip
import hashlib
import random
import zlib

import pytest

from quillon.llm import common, warc
from tests.llm.helpers import prose


def test_round_trip(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n", "é\x00ü\r\n\r\n" * 3, "x" * 300_000, "<p>a</p>", "end\r\n\r\n\r\n\r\n", "<p>a</p>"]
    rows = [(9 - i, f"http://a/{i}\r\nX: y", h, "z") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "z"), (100, None, "dup", "z"), (100, None, "dup", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    path = common.work_path(spark, "warc-test")
    warc.write_warc(pages, path, records_per_file=3)
    got = warc.read_warc(spark, path).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(rows)
    number = lambda s: None if s is None or "null" in s else int(s[12:-1])
    found = sorted((number(r.record_id) is None, number(r.record_id) or 0, r.record_type, number(r.refers_to), r.payload_bytes, r.payload_digest) for r in got)
    want = []
    for i, _, h, _ in rows:
        data = (h or "").encode()
        first = min((j for j, _, g, _ in rows if (g or "") == (h or "") and j is not None), default=None)
        same = i == first
        want.append((i is None, i or 0, "response" if same else "revisit", None if same else first, len(data), warc.sha1_base32(data)))
    assert found == sorted(want)
    payloads = {number(r.record_id): bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(payloads[i] == (h or "").encode() for i, _, h, _ in rows if i in payloads)


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    path = common.work_path(spark, "warc-test")
    warc.write_warc(pages, path, least_bytes=3)
    assert sorted((r.record_id[12:-1], r.record_type) for r in warc.read_warc(spark, path).collect()) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]


def record(k, payload):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nWARC-Payload-Digest: sha1:{warc.sha1_base32(payload)}\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def ids(found):
    return [int(r.headers["warc-record-id"][12:-1]) for r in found.records]


def test_salvage():
    rng = random.Random(3)
    plain = [record(k, prose(rng, 30).encode()) for k in range(8)]
    for parts in (plain, [gzip.compress(r) for r in plain]):
        whole = b"".join(parts)
        assert ids(warc.salvage(whole)) == list(range(8)) and not warc.salvage(whole).gaps
        starts = [sum(map(len, parts[:k])) for k in range(9)]
        # a changed byte in the middle of record 3
        at = starts[3] + len(parts[3]) // 2
        found = warc.salvage(whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :])
        assert ids(found) == [0, 1, 2, 4, 5, 6, 7] and [(g.start, g.end) for g in found.gaps] == [(starts[3], starts[4])]
        # bytes lost, junk put in, the end cut off
        cut = starts[5] + 40
        found = warc.salvage(whole[:at] + whole[cut:])
        assert ids(found) == [0, 1, 2, 6, 7] and len(found.gaps) == 1
        found = warc.salvage(whole[: starts[2]] + b"junk \x1f\x8b\x08 WARC/1.1 junk" + whole[starts[2] :] + b"tail")
        assert ids(found) == list(range(8)) and [g.end - g.start for g in found.gaps] == [22, 4]
        found = warc.salvage(whole[: starts[7] + 30])
        assert ids(found) == list(range(7)) and found.gaps[0].start == starts[7] and found.gaps[0].reason
    assert warc.salvage(b"").records == [] and warc.salvage(b"\x00" * 10).gaps[0].end == 10
    big = record(1, b"a").replace(b"Content-Length: ", b"Content-Length: 99")
    assert ids(warc.salvage(big + record(2, b"b"))) == [2]


def test_salvage_inside_members():
    rng = random.Random(4)
    plain = [record(k, prose(rng, 30).encode()) for k in range(6)]
    broken = b"".join(plain[:2]) + plain[2].replace(b"WARC/1.1", b"WARC/9.9") + b"".join(plain[3:])
    found = warc.salvage(plain[0] + gzip.compress(broken) + gzip.compress(plain[1]))
    assert ids(found) == [0, 0, 1, 3, 4, 5, 1] and [g.data for g in found.gaps] == [broken[len(plain[0] + plain[1]) :][: len(plain[2])]]
    # one member, cut at nine tenths: all records that it gives whole
    for share in (0.5, 0.9):
        member = gzip.compress(b"".join(plain))
        content = zlib.decompressobj(31).decompress(member[: int(len(member) * share)])
        whole = [k for k in range(6) if sum(map(len, plain[: k + 1])) <= len(content)]
        found = warc.salvage(member[: int(len(member) * share)])
        assert ids(found) == whole and whole and len(found.gaps) == 1 and found.gaps[0].reason == "member without end"
    # a changed byte in a member of several records: those before it, and the members after it
    member = bytearray(gzip.compress(b"".join(plain)))
    member[len(member) // 2] ^= 0x55
    found = warc.salvage(bytes(member) + gzip.compress(record(9, b"after")))
    assert set(ids(found)) >= {0, 9} and found.gaps


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, f"http://a/{k}", "".join(rng.choices("abcdefgh", k=300_000 if k % 10 == 0 else 3000))) for k in range(200)] + [(500, None, None), (501, "u" * 90_000, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    path = f"{tmp_path}/warc"
    warc.write_warc(spark.read.parquet(f"{tmp_path}/pages.parquet"), path, records_per_file=64, file_bytes=1 << 20)
    sizes = [f.stat().st_size for f in (tmp_path / "warc").glob("part-*")]
    assert max(sizes) < 3 << 20 and sum(sizes) > 6 << 20
    assert sorted(int(r.record_id[12:-1]) for r in warc.read_warc(spark, f"file://{path}").collect() if r.kind == "record") == sorted(i for i, *_ in rows)


def test_long_headers(spark, monkeypatch, tmp_path):
    rows = [(1, "http://a/" + "u" * 200_000, "<p>a</p>"), (2, "http://a/WARC/1.1", "b"), (3, "http://b/" + "v" * 70_000 + "WARC/1.1", "<p>a</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.record_type for r in warc.op4_warc(spark, str(tmp_path)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit"}
    cut = record(1, b"a").replace(b"\r\n\r\n", b"") + b"x" * 100_000
    assert ids(warc.salvage(cut + b"\r\n" + record(2, b"b"))) == [2]
    monkeypatch.setattr(warc, "read_warc", lambda spark, path: spark.createDataFrame([("a", "gap", "lost")], "archive string, kind string, note string").selectExpr("*", *[f"'' AS {c}" for c in ("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]))
    with pytest.raises(Exception, match="gap in a: lost"):
        warc.op4_warc(spark, str(tmp_path)).collect()


def test_gaps_are_logged(spark, tmp_path):
    good = record(1, b"one")
    (tmp_path / "a.warc").write_bytes(good + b"broken" + record(2, b"two"))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(3, b"three")) + b"\x1f\x8b\x08oops")
    (tmp_path / "c.warc").write_bytes(b"")
    got = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted(r.record_id for r in got if r.kind == "record") == ["<urn:x-page:1>", "<urn:x-page:2>", "<urn:x-page:3>"]
    gaps = {r.archive[-6:]: (r.offset, r.payload_bytes, bytes(r.payload)) for r in got if r.kind == "gap"}
    assert gaps["a.warc"] == (len(good), 6, b"broken") and gaps["arc.gz"][2] == b"\x1f\x8b\x08oops"


def test_base32(spark):
    from pyspark.sql import functions as F

    for text in ("", "a", "é" * 100):
        got = spark.createDataFrame([(text,)], "t string").select(warc.base32_sha1(F.col("t").cast("binary")).alias("d")).first().d
        assert got == warc.sha1_base32(text.encode()) and len(hashlib.sha1(text.encode()).digest()) == 20
