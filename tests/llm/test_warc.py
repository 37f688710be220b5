"""Archives against a plain reading of their format, and the query against brute force."""

import base64
import glob
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import registry, warc

PAGES = "page_id long, url string, html string"


def digest(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


def messy():
    rng = random.Random(11)
    big = "".join(rng.choice("abc<>/\r\né") for _ in range(700_000))
    rows = [
        (5, "http://a/5", "<p>x</p>"), (3, "http://a/3", "<p>x</p>"), (9, None, "<p>x</p>"), (3, "http://a/3", "<p>x</p>"), (3, "http://b/3", "<p>x</p>"), (None, "http://n", "<p>x</p>"), (None, None, "<p>x</p>"), (None, None, "<p>x</p>"),
        (7, "http://e", None), (6, "http://e", ""), (8, "bad\r\nWARC-Type: x ", "\r\n\r\nWARC/1.1\r\n\r\n"), (10, "http://big", big), (11, "http://big", big), (12, "http://big", big + "x"), (None, "http://only", "only null"), (20, "http://ü", "ü\x00\U0001f600"), (21, "", " "),
    ]
    return rows + [(100 + i, f"http://c/{i % 50}", "copy") for i in range(40)] + [(50, "http://same", "repeated")] * 2_500


def wanted(rows, least=0):
    first, out = {}, []
    for i, row in enumerate(rows):
        place = (row[0] is None, row[0] or 0, row[1] is None, row[1] or "", i)
        x = (row[2] or "").encode()
        if len(x) >= least:
            first[x] = min(first.get(x, place), place)
    for i, (page, url, html) in enumerate(rows):
        x = (html or "").encode()
        again = len(x) >= least and first[x][-1] != i
        out.append((page, len(x), digest(x), "revisit" if again else "response", (None if first[x][0] else first[x][1]) if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pages"))
    df = spark.createDataFrame(messy(), PAGES)
    for c in ("record", "page", "order", "m", "k", "is_first", "chunk_no", "payload"):
        df = df.withColumn(c, F.lit("clash"))
    df.repartition(5).write.parquet(f"{d}/pages.parquet")
    return d


def test_query(spark, folder):
    got = registry.QUERIES["op12_warc_chunks"](spark, folder)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted(messy())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert registry.QUERIES["op12_warc_chunks"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("least", [1, 5, 1_000_000_000])
def test_small_payloads_are_all_responses(spark, folder, tmp_path, least):
    to = f"file://{tmp_path}/w"
    archives = warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), to, least=least, most=20_000)
    got = warc.records(warc.read_archives(archives, to, data=False)).selectExpr("cast(page as bigint)", "payload_bytes", "payload_digest", "record_type", "cast(refers_to as bigint)")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted(messy(), least)
    ids = warc.records(warc.read_archives(archives, to, data=False)).select("record_id").collect()
    assert len(set(ids)) == len(ids) == len(messy())


def test_chunks_come_back_in_order(spark, folder, tmp_path):
    to = f"file://{tmp_path}/w"
    archives = warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), to, most=100_000)
    assert archives.count() > 2
    rows = warc.read_archives(archives, to).collect()
    by = {}
    for r in rows:
        if r.record_type == "response":
            by.setdefault(r.record_id, []).append(r)
    found = set()
    for own in by.values():
        own.sort(key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in own] == list(range(len(own))) and [r.last for r in own] == [False] * (len(own) - 1) + [True]
        x = b""
        for r in own:
            assert len(r.data) <= warc.CHUNK
            x += r.data
            assert (r.payload_bytes, r.payload_digest) == (len(x), digest(x))
        found.add(x)
    assert found == {(t or "").encode() for *_, t in messy()} and max(map(len, by.values())) >= 3
    (odd,) = [r for r in rows if r.page == "8"]
    assert odd.target_uri == "bad%0D%0AWARC-Type:%20x%E2%80%A8"


def test_archives_are_plain_warc(spark, folder, tmp_path):
    """Members unpack one by one; every block has its stated length, and a refers-to names a record that exists."""
    to = f"file://{tmp_path}/w"
    warc.write_archives(spark.read.parquet(f"{folder}/pages.parquet"), to)
    ids, refers = set(), set()
    for f in glob.glob(f"{tmp_path}/w/*.warc.gz"):
        with gzip.open(f) as s:
            data = s.read()
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
            assert data[at:].startswith(b"WARC/1.1\r\n") and lines["WARC-Type"] in {"warcinfo", "response", "revisit"}
            at = end + 4 + int(lines["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            if lines["WARC-Type"] == "response":
                ids.add(lines["WARC-Record-ID"])
            refers |= {lines["WARC-Refers-To"]} if "WARC-Refers-To" in lines else set()
    assert refers <= ids and refers


def test_plain_and_broken_archives():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nX-Folded: a\r\n b\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block)
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    whole = head + block + b"\r\n\r\n" + other
    for data in (whole, gzip.compress(whole), gzip.compress(whole[:100]) + gzip.compress(whole[100:])):
        one, two = warc.unpacked(io.BytesIO(data))
        assert one[0] == "<urn:uuid:1>" and one[-3:] == (5, digest(b"hello"), b"hello") and two[-1] == b"abc"
    for bad in (whole[:-40], gzip.compress(whole)[:-20], b"junk" + whole, whole.replace(b"Type: response", b"Type: response\r\nWARC-Payload-Digest: sha1:AAAA", 1)):
        with pytest.raises(ValueError):
            list(warc.unpacked(io.BytesIO(bad)))


def test_reading_stays_small():
    """A record of 64 MB is never held: chunks are bounded, whatever it unpacks to."""
    n = 64 << 20
    block = b"HTTP/1.1 200 OK\r\n\r\n"
    packed = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (n + len(block)) + block + bytes(n) + b"\r\n\r\n", 1)
    s, total = warc.unpacked(io.BytesIO(packed)), 0
    for row in s:
        assert len(row[-1]) <= warc.CHUNK
        total += len(row[-1])
    assert total == n
