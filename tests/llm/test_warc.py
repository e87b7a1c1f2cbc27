import gzip
import os
import random

from quarry.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, key bigint, maybe int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, 2) for i, u, h in rows], SCHEMA)


def test_round_trip_cases(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (5, None, "same"), (3, "http://x\r\ny", None), (4, "", ""),
            (6, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"), (7, "u", "é\r\n\r\n" * 3),
            (8, "u", "x" * 300_000), (None, "u", "same")]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows)).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, _, h in rows:
        data = (h or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == warc.sha1_of(data)
    assert [got[i].refers_to for i in (1, 2, 5, 3, 4, 6, 7, 8, None)] == [5, 5, None, 4, None, None, None, None, 5]
    assert got[5].record_type == "response" and got[1].record_type == "revisit"


def test_payload_comes_back(spark, tmp_path):
    rows = [(i, "u", f"<p>é {i}</p>\r\n" * i) for i in range(40)]
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, rows), path, archive_bytes=4000)
    back = {r.page_id: bytes(r.payload).decode() for r in warc.read_archives(spark, path).collect() if r.payload is not None}
    assert back == {i: h for i, _, h in rows}
    assert len([f for f in os.listdir(path) if f.endswith(".gz")]) > 1


def test_min_bytes_and_empty_table(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    got = {r.page_id: r.record_type for r in warc.round_trip(pages(spark, rows), min_revisit_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(pages(spark, [])).count() == 0


def record(i, body):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    return (b"WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: %d\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n"
            % (i, warc.sha1_of(block).encode(), len(block))) + block + b"\r\n\r\n"


def ids(raw):
    return [int(x[3]["x-page-id"]) for x in warc.read_bytes(raw) if x[0] == "record"]


def gaps(raw):
    return [(x[1], x[2]) for x in warc.read_bytes(raw) if x[0] == "gap"]


def test_salvage_plain():
    parts = [record(i, bytes([65 + i]) * (50 + i)) for i in range(6)]
    raw = b"".join(parts)
    assert ids(raw) == list(range(6)) and gaps(raw) == []
    at = len(parts[0])
    bad = raw[:at + len(parts[1]) - 9] + b"?" + raw[at + len(parts[1]) - 8:]   # a byte of the second block
    assert ids(bad) == [0, 2, 3, 4, 5] and gaps(bad) == [(at, at + len(parts[1]))]
    cut = raw[:at + 3] + raw[at + 20:]                                 # the version line is gone
    assert ids(cut) == [0, 2, 3, 4, 5]
    assert ids(raw[:-10]) == [0, 1, 2, 3, 4]
    assert ids(parts[0] + b"garbage\r\n" + parts[1]) == [0, 1]
    assert gaps(parts[0] + b"garbage\r\n" + parts[1]) == [(at, at + 9)]


def test_salvage_members():
    rng = random.Random(5)
    parts = [gzip.compress(record(i, rng.randbytes(400))) for i in range(8)]
    raw = b"".join(parts)
    assert ids(raw) == list(range(8)) and gaps(raw) == []
    a, b = len(parts[0]) + 200, len(parts[0]) + 240
    broken = raw[:a] + bytes(40) + raw[b:]
    assert ids(broken) == [0, 2, 3, 4, 5, 6, 7]
    assert any(lo <= a and hi >= b for lo, hi in gaps(broken))
    assert ids(raw[:-20])[:7] == list(range(7))
    assert ids(parts[0] + b"\x1f\x8b\x08junk" + parts[1]) == [0, 1]
    whole = gzip.compress(b"".join(record(i, b"x" * 5000) for i in range(20)))
    assert ids(whole[:len(whole) - 12]) == list(range(20)) or len(ids(whole[:len(whole) - 12])) >= 18
    assert list(warc.read_bytes(b"")) == []
