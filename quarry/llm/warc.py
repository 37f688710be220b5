"""WARC archives through a chunked record table.

A payload travels as rows (record, chunk number, bytes) of at most ``CHUNK`` bytes, never as one value once it has left its table; digests
are carried from chunk to chunk, when archives are written and when they are read back.

Writing takes two passes over the pages.  The first measures every payload (length, SHA-1 and a second digest) and decides, by
grouping those small rows, which page holds a payload first: it becomes a ``response``, all others become ``revisit`` records that
refer to it.  The second cuts payloads into chunk rows, each payload once in a task, and sends them to the task that got the response's head
row, which has chunk number -1 and so stands before them; that task streams them into the archive.  Revisits need no chunks and are dealt by a hash of
their own, so a payload with a third of all pages is no hot spot; pages equal in all columns are one row with a count until the end.

An archive is a ``.warc.gz`` file with a member for each record and a ``warcinfo`` record first.  Tasks write files under new names
through ``pyarrow.fs``; a table of the names is what a job commits, so files of lost attempts are never read.

Reading streams every archive into chunk rows; :func:`records` keeps the last of each record, which has its length and digest.

Defined results: a null payload is an empty one; null keys come last when the first page is chosen, then null addresses; repeated rows are
records of their own, of which one at most is a response; other columns are ignored; an empty table gives no archive and no record.  Line breaks and control
characters in an address are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted, documents, dropped, partitions, released, scratch, written

#: Bytes of a chunk, of an archive before a new one begins, of a header at most, and of what a task sends on at once.
CHUNK, ARCHIVE, HEADER, BATCH = 1 << 18, 1 << 28, 1 << 20, 4 << 20
#: Payloads that a task remembers to have sent, and equal pages that one head row stands for.
REMEMBERED, BLOCK = 1 << 16, 1_000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EDGE = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

HEAD = ["role", "page", "url", "first_page", "first_url", "occ", "times", "size", "sha1"]
HEAD_TYPES = "role string, page string, url string, first_page string, first_url string, occ bigint, times bigint, size bigint, sha1 binary"
ROWS = f"record binary, chunk_no bigint, data binary, {HEAD_TYPES}"
CHUNKS = "record_id string, chunk_no bigint, last boolean, record_type string, page string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, data binary"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def buffers(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each value, without a copy; those of a null are empty."""
    for x in column.cast(pa.large_binary()):
        yield memoryview(x.as_buffer()) if x.is_valid else memoryview(b"")


def digested(payload: memoryview) -> tuple[bytes, bytes]:
    """SHA-1, and what names the payload: a second digest and SHA-1.  Both are carried over the chunks."""
    one, two = hashlib.sha1(usedforsecurity=False), hashlib.blake2b(digest_size=16)
    for at in range(0, len(payload), CHUNK):
        part = payload[at : at + CHUNK]
        one.update(part)
        two.update(part)
    return one.digest(), two.digest() + one.digest()


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, url, record, size, sha1) of (page, url, payload)."""
    for b in batches:
        sizes, names, sha1 = [], [], []
        for x in buffers(b.column(2)):
            one, name = digested(x)
            sizes.append(len(x))
            names.append(name)
            sha1.append(one)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sha1, pa.binary())], ["page", "url", "record", "size", "sha1"])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["record", "chunk_no", "data", *HEAD])


def cut(least: int):
    """Chunk rows of (page, url, payload).  Payloads under ``least`` bytes are records of their own and bring their head rows along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, None] = {}
        none = (None,) * len(HEAD)
        rows, held = [], 0
        for b in batches:
            for page, url, x in zip(b.column(0), b.column(1), buffers(b.column(2)), strict=True):
                if not len(x) and least <= 0:
                    continue
                one, name = digested(x)
                if len(x) < least:
                    name += uuid.uuid4().bytes
                    rows.append((name, -1, None, "response", page.as_py(), url.as_py(), None, None, int.from_bytes(name[-7:], "big"), 1, len(x), one))
                elif name in sent:
                    continue
                else:
                    sent[name] = None
                    if len(sent) > REMEMBERED:
                        del sent[next(iter(sent))]
                for no, at in enumerate(range(0, len(x), CHUNK)):
                    rows.append((name, no, bytes(x[at : at + CHUNK]), *none))
                    held += min(CHUNK, len(x) - at)
                    if held >= BATCH:
                        yield _batch(rows)
                        rows, held = [], 0
                if len(rows) >= 2_000:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    return run


def heads(pages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Head rows of (page, url, record, size, sha1), and the tables that they read."""
    seen = written(pages.groupBy("page", "order", "url", "record", "size", "sha1").agg(F.count(F.lit(1)).alias("m")), "warc-measured")
    # nulls last; the page's own order, which for numbers is not that of their texts
    place = F.struct(F.col("order").isNull().alias("x"), F.col("order").alias("order"), F.col("url").isNull().alias("y"), F.col("url").alias("url"), F.col("page").alias("page"))
    first = written(seen.groupBy("record").agg(F.min(place).alias("f")).select("record", F.col("f.page").alias("first_page"), F.col("f.url").alias("first_url")), "warc-first")
    both = seen.join(first, "record").withColumn("is_first", F.col("page").eqNullSafe(F.col("first_page")) & F.col("url").eqNullSafe(F.col("first_url")))
    both = both.withColumn("k", F.explode(F.sequence(F.lit(0), ((F.col("m") - 1) / BLOCK).cast("long"))))
    response = F.col("is_first") & (F.col("k") == 0)
    own = F.unhex(F.md5(F.concat_ws("\x00", F.coalesce("page", F.lit("")), F.coalesce("url", F.lit("")), F.hex("record"), F.col("k").cast("string"))))
    out = both.select(
        F.when(response, F.col("record")).otherwise(own).alias("record"), F.lit(-1).cast("long").alias("chunk_no"), F.lit(None).cast("binary").alias("data"),
        F.when(response, "response").otherwise("revisit").alias("role"), "page", "url", "first_page", "first_url", (F.col("k") * BLOCK).alias("occ"), F.least(F.lit(BLOCK), F.col("m") - F.col("k") * BLOCK).alias("times"), "size", "sha1",
    )
    return out, [seen, first]


def address(url: str | None) -> str:
    return "" if url is None else hashlib.blake2b(url.encode(), digest_size=8).hexdigest()


def record_id(page: str | None, occ: int, url: str | None, digest: str) -> str:
    return f"<urn:x-page:{'n' if page is None else 'k' + quote(page, safe='')}:{occ}:{address(url)}:{digest}>"


def page_of(record: str | None) -> str | None:
    """The page that an identifier of :func:`record_id` names."""
    part = (record or "").strip("<>").split(":")
    return unquote(part[2][1:]) if len(part) == 6 and part[1] == "x-page" and part[2].startswith("k") else None


def header(kind: str, record: str, date: str, length: int, content: str, more: list[tuple[str, str]]) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record), ("WARC-Date", date), *more, ("Content-Type", content), ("Content-Length", str(length))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"


class Archive:
    """Writes records to new files of a folder, one after the other."""

    def __init__(self, folder: str, date: str, level: int, most: int):
        self.files, self.path = fs.FileSystem.from_uri(folder)
        self.files.create_dir(self.path, recursive=True)
        self.date, self.level, self.most = date, level, most
        self.out, self.zip, self.done = None, None, []

    def open(self) -> None:
        self.name, self.bytes, self.records = f"{self.path}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
        self.out = self.files.open_output_stream(self.name, compression=None)
        info = b"software: quarry\r\nformat: WARC File Format 1.1\r\n"
        self.begin(header("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", self.date, len(info), "application/warc-fields", []) + info)
        self.end()

    def put(self, x: bytes) -> None:
        if x:
            self.bytes += len(x)
            self.out.write(x)

    def begin(self, x: bytes) -> None:
        if self.out is None:
            self.open()
        self.zip = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.put(self.zip.compress(x))

    def add(self, x: bytes) -> None:
        self.put(self.zip.compress(x))

    def end(self) -> None:
        self.put(self.zip.compress(EDGE) + self.zip.flush())
        self.zip = None
        self.records += 1
        if self.bytes >= self.most:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.bytes, self.records))
            self.out = None

    def head(self, kind: str, page: str | None, url: str | None, occ: int, size: int, digest: str, first: str | None) -> None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
        more = [] if url is None else [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: quote(m[0]), url))]
        more.append(("WARC-Payload-Digest", f"sha1:{digest}"))
        if kind == "revisit":
            more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", first)]
        self.begin(header(kind, record_id(page, occ, url, digest), self.date, len(http) + (size if kind == "response" else 0), "application/http; msgtype=response", more) + http)


def archived(folder: str, date: str, level: int, most: int):
    """Writes sorted head and chunk rows; yields (path, bytes, records) of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_record, due, left, sha = None, None, 0, 0, None

        def finish():
            nonlocal open_record
            if open_record is None:
                return
            if left or sha.digest() != open_record[-20 - 16 * (len(open_record) > 36) :][:20]:
                raise ValueError(f"the chunks of {open_record.hex()} are not those of its payload")
            out.end()
            open_record = None

        for b in batches:
            names, numbers, roles = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()
            for i, (name, no, role) in enumerate(zip(names, numbers, roles, strict=True)):
                if role is None:
                    if name != open_record:
                        raise ValueError(f"chunk {no} of {name.hex()} has no head")
                    if no < due:  # another task has sent the same payload
                        continue
                    if no > due:
                        raise ValueError(f"chunk {due} of {name.hex()} is missing")
                    (x,) = buffers(b.column(2).slice(i, 1))
                    due, left = due + 1, left - len(x)
                    sha.update(x)
                    out.add(x)
                    continue
                finish()
                out = out or Archive(folder, date, level, most)
                page, url, first_page, first_url, occ, times, size, sha1 = (b.column(c)[i].as_py() for c in range(4, 12))
                digest = base32(sha1)
                first = record_id(first_page, 0, first_url, digest)
                for j in range(1 if role == "response" else 0, times):
                    out.head("revisit", page, url, occ + j, size, digest, first)
                    out.end()
                if role == "response":
                    out.head("response", page, url, occ, size, digest, None)
                    open_record, due, left, sha = name, 0, size, hashlib.sha1(usedforsecurity=False)
        finish()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.done, strict=True), [pa.string(), pa.int64(), pa.int64()], strict=True)], ["path", "bytes", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = DATE, level: int = 4, most: int = ARCHIVE) -> DataFrame:
    """Writes a record for each row of ``pages`` into archives under ``folder``; returns their table (path, bytes, records).

    Of pages with equal payloads of ``least`` bytes or more, that with the smallest key (nulls last) is the response.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{key}`").cast("string").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{payload}`").cast("binary").alias("payload"))
    small = F.coalesce(F.octet_length("payload"), F.lit(0)) < least
    # the key's own type gives the order; it is read back from its text
    kind = pages.schema[key].dataType.simpleString()
    large = rows if least <= 0 else rows.filter(~small)
    found = large.mapInArrow(measured, "page string, url string, record binary, size bigint, sha1 binary").withColumn("order", F.col("page").cast(kind))
    head, used = heads(found)
    both = head.unionByName(rows.mapInArrow(cut(least), ROWS))
    dealt = both.repartition(partitions(spark), "record").sortWithinPartitions("record", "chunk_no")
    out = written(dealt.mapInArrow(archived(folder, date, level, most), "path string, bytes bigint, records bigint"), "warc-archives")
    dropped(*used)
    return out


class Stream:
    """The unpacked bytes of an archive, in pieces of bounded size."""

    def __init__(self, file):
        self.file, self.have, self.raw, self.zip = file, bytearray(), b"", None
        self.packed: bool | None = None

    def more(self) -> bool:
        """Appends some bytes; False at the end."""
        while True:
            if not self.raw:
                self.raw = self.file.read(CHUNK)
                if not self.raw:
                    if self.zip is not None:
                        raise ValueError("the archive ends inside a record")
                    return False
            if self.packed is None:
                self.packed = self.raw[:2] == b"\x1f\x8b"
            if not self.packed:
                self.have += self.raw
                self.raw = b""
                return True
            if self.zip is None:
                self.zip = zlib.decompressobj(31)
            got = self.zip.decompress(self.raw, CHUNK)
            if self.zip.eof:
                self.raw, self.zip = self.zip.unused_data, None
            else:
                self.raw = self.zip.unconsumed_tail
            if got:
                self.have += got
                return True

    def until(self, mark: bytes, most: int = HEADER) -> bytes | None:
        """The bytes up to ``mark``, which is left out; None at the archive's end."""
        at = 0
        while (i := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark) + 1)
            if len(self.have) > most:
                raise ValueError("a header is too long")
            if not self.more():
                if self.have.strip(b"\r\n"):
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.have[:i])
        del self.have[: i + len(mark)]
        return out

    def begin(self) -> bool:
        """Passes the line ends between two records; False at the archive's end."""
        while True:
            n = 0
            while n < len(self.have) and self.have[n] in b"\r\n":
                n += 1
            del self.have[:n]
            if self.have:
                return True
            if not self.more():
                return False

    def some(self, most: int) -> bytes:
        """Up to ``most`` bytes, at least one."""
        if not self.have and not self.more():
            raise ValueError("the archive ends inside a block")
        out = bytes(self.have[:most])
        del self.have[:most]
        return out


def fields(lines: bytes) -> dict[str, str]:
    """Header fields by their names in lower case; a folded line goes on its field's value."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", lines).split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def unpacked(file) -> Iterator[tuple]:
    """(record_id, chunk_no, last, type, target_uri, refers_to, payload bytes so far, their digest, data) of all records with a block.

    ``data`` are bytes of the payload; a record without any has one row.  A revisit's length and digest are those that it states.
    """
    s = Stream(file)
    while s.begin():
        lines = s.until(EDGE)
        if lines is None or not lines.startswith(b"WARC/"):
            raise ValueError("this is no WARC record")
        f = fields(lines)
        left = int(f["content-length"])
        kind, http = f.get("warc-type", ""), {}
        if f.get("content-type", "").replace(" ", "").startswith("application/http") and left:
            block = s.until(EDGE)
            if block is None or len(block) + len(EDGE) > left:
                raise ValueError(f"{f.get('warc-record-id')} has no HTTP header")
            left -= len(block) + len(EDGE)
            http = fields(block)
        sha, size, no = hashlib.sha1(usedforsecurity=False), 0, 0
        stated = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
        head = (kind, f.get("warc-target-uri"), f.get("warc-refers-to"))
        while True:
            # whole chunks, whatever the pieces that the archive unpacks to
            data = bytearray()
            while left and len(data) < CHUNK:
                part = s.some(min(left, CHUNK - len(data)))
                left -= len(part)
                data += part
            sha.update(data)
            size += len(data)
            total, digest = (int(http.get("content-length", size)), stated) if kind == "revisit" else (size, base32(sha.digest()))
            yield f.get("warc-record-id"), no, not left, *head, total, digest, bytes(data)
            no += 1
            if not left:
                break
        if kind == "response" and stated and base32(sha.digest()) != stated:
            raise ValueError(f"{f.get('warc-record-id')} has another payload than its digest says")


def read_back(folder: str, data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["record_id", "chunk_no", "last", "record_type", "page", "target_uri", "refers_to", "payload_bytes", "payload_digest", "data"]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                with files.open_input_stream(path, compression=None) as file:
                    for record, no, last, kind, target, refers, size, digest, x in unpacked(file):
                        rows.append((record, no, last, kind, page_of(record), target, page_of(refers), size, digest, x if data else None))
                        held += len(x) * data
                        if held >= BATCH or len(rows) >= 5_000:
                            yield make(rows)
                            rows, held = [], 0
        if rows:
            yield make(rows)

    return run


def read_archives(archives: DataFrame, folder: str, data: bool = True) -> DataFrame:
    """Chunk rows of all records in ``archives`` (a table with their ``path``): CHUNKS.  ``payload_bytes`` and ``payload_digest`` are those of
    the payload up to and with the chunk.  Without ``data`` payloads are read and digested, but not returned."""
    spark = archives.sparkSession
    return archives.select("path").repartition(partitions(spark) * 2, "path").mapInArrow(read_back(folder, data), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row for each page's record, from its last chunk."""
    return chunks.filter(F.col("last") & F.col("record_type").isin("response", "revisit")).drop("chunk_no", "last", "data")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    archives = write_archives(documents(spark, sf_dir, "pages"), folder)
    got = records(read_archives(archives, folder, data=False))
    out = written(got.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", F.col("refers_to").cast("long")).alias("refers_to")), "warc-records")
    deleted(spark, folder)
    dropped(archives)
    released(spark)
    return out


#: The digest's 160 bits are eight groups of five hexadecimal figures, each of which is four letters.
OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
h AS (SELECT page_id, x, strlen(x) AS n, sha1(x) AS h, row_number() OVER w AS r, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY x ORDER BY page_id NULLS LAST)),
g AS (SELECT *, [('0x' || substr(h, 5 * i + 1, 5))::BIGINT FOR i IN range(8)] AS g FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INTEGER + 1, 1) FOR s IN [15, 10, 5, 0]], '') FOR v IN g], '') AS payload_digest,
  CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r > 1 THEN first END AS refers_to
FROM g
"""
