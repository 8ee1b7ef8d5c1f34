"""Archives with very long urls, and members that are damaged rather than cut off."""

import gzip
import hashlib
import random
import re

from lociframe.llm import warc


def test_very_long_urls(spark, tmp_path):
    urls = ["http://x.org/" + "a" * 150_000, "http://x.org/" + "ä b" * 40_000, "http://x.org/"]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    for compression in ("gzip", "none"):
        path = str(tmp_path / compression)
        warc.write(pages, path, compression)
        out = warc.read(spark, path).collect()
        assert sorted((r.kind, r.page_id, r.payload_bytes) for r in out) == [("record", i, 6) for i in range(3)]


def test_header_without_an_end_stops_at_the_next_version_line():
    good = record(1, b"x")
    bad = b"WARC/1.1\r\nWARC-Target-URI: " + b"a" * 100_000
    assert ids(bad + b"\r\n" + good) == [1]


def record(k, body):
    block = warc.HTTP.encode() + body
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\n"
    return f"{head}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + warc.END


def ids(data):
    return [int(re.search(r"\d+", x[3]["warc-record-id"])[0]) for x in warc.salvage(data) if x[0] == "record"]


def test_damaged_member_of_many_records():
    rng = random.Random(1)
    parts = [record(k, " ".join(str(rng.random()) for _ in range(20)).encode()) for k in range(200)]
    data = bytearray(gzip.compress(b"".join(parts), mtime=0))
    assert len(data) < 1 << 16
    bad_crc = bytearray(data)
    bad_crc[-6] ^= 1
    assert ids(bytes(bad_crc)) == list(range(200))
    late = bytearray(data)
    late[-2000:-1990] = b"\xff" * 10
    got = ids(bytes(late))
    assert got[:150] == list(range(150)) and set(got) <= set(range(200))
    after = record(999, b"z")
    assert ids(bytes(late) + gzip.compress(after, mtime=0))[-1] == 999
    assert [x[:3] for x in warc.salvage(bytes(bad_crc)) if x[0] == "gap"] == [("gap", 0, len(data))]
