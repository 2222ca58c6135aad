"""Archives written and read back, against plain Python."""

import base64
import gzip
import hashlib
import random

import pytest

from retort.llm import warc
from retort.llm.queries import op4_warc


def plain(rows, least=0):
    first, out = {}, []
    for i, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            first[body] = min(first.get(body, i), i)
    for i, html in rows:
        body = (html or "").encode()
        refers = first.get(body) if len(body) >= least else None
        refers = None if refers == i else refers
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_query_matches_plain(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/pages.parquet").select("page_id", "html").collect()]
    out = op4_warc(spark, sf_small)
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got(out) == plain(rows)


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_odd_pages_and_small_splits(spark, tmp_path, split):
    draw = random.Random(1)
    noise = "".join(chr(draw.randrange(1, 0x2000)) for _ in range(30_000))
    rows = [(5, "a"), (3, "a"), (9, "a"), (3, "a"), (1, None), (2, ""), (None, "a"), (7, "é😀" * 3000), (8, noise), (11, "\r\n\r\nWARC/1.1\r\n"), (12, "\x1f\x8b\x08" * 50)]
    pages = spark.createDataFrame([(i, f"http://x/{i}\nz", h, 1) for i, h in rows], "page_id long, url string, html string, sha int").repartition(2)
    files = warc.write_archives(pages, f"{tmp_path}/w")
    assert got(warc.read_archives(files, split)) == plain(rows)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(files, split).filter("record_type = 'response'").collect()}
    assert payloads[8] == noise and payloads[12] == "\x1f\x8b\x08" * 50
    for r in files.collect():  # any gzip reader reads the archive
        assert gzip.open(r["path"]).read().count(b"WARC-Record-ID") == r["records"]


def test_stored_members_with_magic_inside(tmp_path):
    import zlib

    inner = gzip.compress(warc.record(1, "u", b"inner", None, warc.digest(b"inner"), 5))[:40] + b"\x1f\x8b\x08\x00junk"
    data, starts = b"", []
    for i in range(20):
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: what lies inside stays visible
        starts.append(len(data))
        data += packer.compress(warc.record(i, "u", inner * 3, None, warc.digest(inner * 3), len(inner) * 3)) + packer.flush()
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    for step in (50, 333, 10_000):
        found = [r["page_id"] for at in range(0, len(data), step) for r in warc.records_of_range(str(path), at, min(at + step, len(data)))]
        assert found == list(range(20))


def test_least_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert got(warc.round_trip(pages, 3)) == plain([(1, "ab"), (2, "ab"), (3, "abcd"), (4, "abcd")], 3)
    assert warc.round_trip(pages.limit(0)).count() == 0


def member(text, level=9):
    import zlib

    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(text) + packer.flush()


def foreign(kind, block, *lines, version="WARC/1.0"):
    head = [version, f"warc-type: {kind}", f"WARC-RECORD-ID: <urn:uuid:{kind}>", *lines, f"content-length:{len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def read_all(spark, path, split):
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    return warc.read_archives(files, split).collect()


def archive(level):
    """All kinds of records, and an archive as a payload, whose members lie open inside if nothing is compressed."""
    nested = b"".join(member(warc.record(900 + i, "n", b"nested" * 9, None, warc.digest(b"nested" * 9), 54)) for i in range(60))
    page = b"HTTP/1.1 200 OK\r\nx-long: a\r\n  b\r\n\r\n" + b"<p>body</p>" * 200
    records = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields"), foreign("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://x/"),
        foreign("response", page, "Content-Type: application/http;msgtype=response", "WARC-Target-URI:", " http://x/"), foreign("metadata", b"k: v", "Content-Type: text/plain"),
        foreign("resource", nested, "Content-Type: application/warc", "WARC-Payload-Digest: sha1:GIVEN"), foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "Content-Type: application/http", "WARC-Refers-To: <urn:uuid:response>"), foreign("conversion", b"text"),
    ]
    return [member(r, level) for r in records for _ in range(2)], nested


@pytest.mark.parametrize("level", [0, 9])
@pytest.mark.parametrize("split", [1000, 4096, 1 << 20])
def test_archives_of_other_writers(spark, tmp_path, split, level):
    members, nested = archive(level)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    rows = read_all(spark, path, split)
    assert sorted(r["record_type"] for r in rows) == sorted(["warcinfo", "request", "response", "metadata", "resource", "revisit", "conversion"] * 2)
    by = {r["record_type"]: r for r in rows}
    assert by["response"]["payload_bytes"] == 2200 and by["response"]["payload_digest"] == warc.digest(b"<p>body</p>" * 200) and by["response"]["url"] == "http://x/"
    assert bytes(by["resource"]["payload"]) == nested and by["resource"]["payload_digest"] == "GIVEN" and by["metadata"]["payload_bytes"] == 4
    assert by["revisit"]["payload"] is None and by["revisit"]["payload_bytes"] is None and by["request"]["payload_bytes"] == 0
    assert all(r["page_id"] is None and r["refers_to"] is None and r["record_id"].startswith("<urn:uuid:") for r in rows)


@pytest.mark.parametrize("cut", [3, 40, 200])
@pytest.mark.parametrize("split", [512, 1 << 20])
def test_cut_off_archives_are_errors(spark, tmp_path, cut, split):
    draw = random.Random(2)
    bodies = [bytes(draw.randrange(256) for _ in range(600)) for _ in range(6)]
    data = b"".join(member(warc.record(i, "u", b, None, warc.digest(b), len(b))) for i, b in enumerate(bodies))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    assert len(read_all(spark, path, split)) == 6
    path.write_bytes(data[:-cut])
    with pytest.raises(Exception, match="cut off|no record"):
        read_all(spark, path, split)
    path.write_bytes(data + b"something else")
    with pytest.raises(Exception, match="cut off|no record"):
        read_all(spark, path, split)
