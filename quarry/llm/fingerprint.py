"""Document fingerprints: canonical exact digests.

A text is normalised (Unicode NFKC, full case folding, NFKC again, runs of white space to one blank, ends trimmed) and hashed to
128 bits of xxhash, so texts that differ in form only have one fingerprint.  Documents are grouped by it, and inside each bucket
of equal digests canonical bytes are compared: should two canonical texts ever meet in a digest, they stay two groups, and a document
finds its own by digest and text.

``likeness`` of exact digests is 1 where canonical texts are equal, else 0.

Grouping shuffles a digest for each document, and the canonical bytes only of documents whose digest occurs again; equal bytes
collapse before the shuffle, so a digest with millions of copies is one row for each map task.

``with_next`` pairs each document with its successor in the order of a key without sorting the table in one task: keys are cut
into ranges at their quantiles, found by bisection, each range's least row is also sent to the range before it, and ranges are
streamed in order.  Rows of one key stay in one range; keys are meant to name documents.

Defined results: a null text is empty; null keys come first; documents with equal keys are ordered by their texts; the only
document of a table is its own successor; repeated rows are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, dropped, partitions, written
from .filters import Filter

SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, canon_sha256 string"


def canonical(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def digest(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as many first code points of ``after``, or all."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


def range_of(key: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` are at or below the key, by bisection; null for a null key."""
    array = F.expr(f"from_json('{json.dumps(cuts)}', 'array<double>')")

    def half(state: Column, _: Column) -> Column:
        # the answer lies in lo..hi
        mid = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        below = F.get(array, mid) <= key
        return F.when(state["lo"] >= state["hi"], state).when(below, F.struct((mid + 1).alias("lo"), state["hi"].alias("hi"))).otherwise(F.struct(state["lo"].alias("lo"), mid.alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    return F.when(key.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(len(cuts).bit_length())), start, half)["lo"])


def with_next(docs: DataFrame, schema: str, of_pair, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``of_pair(key, text, next_text)`` for each document and its successor in key order, wrapping around."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    spark = docs.sparkSession
    ids = rows.select("k")
    n = partitions(spark)
    cuts = sorted(set(ids.approxQuantile("k", [i / n for i in range(1, n)], 1 / (8 * n))))
    bucket = F.coalesce(range_of(F.col("k").cast("double"), cuts), F.lit(0))
    # a row for each range: the least key, and the range that comes before it (the last, for the first)
    least = ids.groupBy(bucket.alias("b")).agg(F.min(F.struct(F.col("k").isNotNull().alias("some"), F.col("k").alias("k"))).alias("least"))
    every = Window.orderBy("b")
    heads = least.select("b", F.col("least.k").alias("head"), F.coalesce(F.lag("b").over(every), F.last("b").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    tagged = rows.withColumn("b", bucket).join(F.broadcast(heads), "b")
    own = F.struct(F.col("b").alias("b"), F.lit(0).alias("extra"))
    sent = F.when(F.col("k").eqNullSafe(F.col("head")), F.array(own, F.struct(F.col("before").alias("b"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    dealt = tagged.select("k", "t", F.explode(sent).alias("s")).select(F.col("s.b").alias("b"), F.col("s.extra").alias("extra"), "k", "t")
    dealt = dealt.repartition(n, "b").sortWithinPartitions("b", "extra", F.col("k").asc_nulls_first(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, names = [], None, pa_schema.names
        size = 0
        for b in batches:
            cols = [b.column(i) for i in range(4)]
            for i in range(b.num_rows):
                row = tuple(c[i].as_py() for c in cols)
                # a range ends with the head of the next one; further rows that were sent along (equal keys) are not needed
                if held is not None and row[0] == held[0] and not held[1]:
                    out.append(of_pair(held[2], held[3], row[3]))
                    size += 1
                held = row
                if size >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), pa_schema.types, strict=True)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), pa_schema.types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return dealt.mapInArrow(run, schema)


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_of: Callable[[str], str] = digest) -> DataFrame:
    """(key, digest) for each document; one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([digest_of(canonical(t.as_py() or "")) for t in b.column(1)], pa.string())], ["doc_id", "digest"])

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, "doc_id bigint, digest string")


def _number(digests: list[str]) -> np.ndarray:
    return np.array([int(d[:16], 16) >> 1 for d in digests], np.int64)


def repeated_digests(digests: DataFrame) -> Filter:
    """A filter of the digests that occur more than once.

    It only spares canonical bytes the shuffle: what passes by chance costs a row and changes nothing, and so does an open filter.
    """
    again = digests.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    # the first 63 bits, from two halves, as a number above 2**63 is none
    number = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * (1 << 31) + F.floor(F.conv(F.substring("digest", 9, 8), 16, 10).cast("long") / 2).cast("long")
    again = written(again.select(number.alias("h")), "fingerprint-again")
    out = Filter.of(again, "h")
    dropped(again)
    return out


def groups(docs: DataFrame, digests: DataFrame | None = None, key: str = "doc_id", text: str = "text", digest_of: Callable[[str], str] = digest) -> DataFrame:
    """Groups of documents with equal canonical texts, where a digest occurs again: (digest, canon_sha256, rank, size, first_doc_id).

    ``rank`` counts the different canonical texts of a digest from 0; above 0 means that digests collided.
    """
    found = repeated_digests(fingerprinted(docs, key, text, digest_of) if digests is None else digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            canon = [canonical(t.as_py() or "") for t in b.column(1)]
            digests = [digest_of(c) for c in canon]
            keys = b.column(0).to_pylist()
            rows = [(keys[i], digests[i], canon[i].encode("utf-8", "surrogatepass")) for i in np.flatnonzero(found.passes(_number(digests))).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.binary()], strict=True)], ["doc_id", "digest", "canon"])

    bytes_of = docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, "doc_id bigint, digest string, canon binary")
    # equal bytes meet here, and only equal bytes: this is the comparison inside a bucket
    same = bytes_of.groupBy("digest", "canon").agg(F.count("*").alias("size"), F.min("doc_id").alias("first_doc_id"))
    narrow = same.select("digest", F.sha2("canon", 256).alias("canon_sha256"), "size", "first_doc_id")
    # a digest has one row here unless digests collided
    ranked = narrow.withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("canon_sha256")) - 1)
    return ranked.filter((F.col("size") > 1) | (F.col("rank") > 0))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", digest_of: Callable[[str], str] = digest) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with the byte-compared group of each document."""

    def of_pair(k, t, after):
        e = edited(t, after)
        a, b, c = canonical(t), canonical(e), canonical(after)
        sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (e, a)]
        return k, len(t), sha[0], digest_of(a), digest_of(b), float(a == b), float(a == c), sha[1]

    rows = written(with_next(docs, SCHEMA, of_pair, key, text), "fingerprints")
    found = groups(docs, rows.select(F.col("fingerprint").alias("digest")), key, text, digest_of).select(
        F.col("digest").alias("_q_digest"), F.col("canon_sha256").alias("_q_sha"), F.col("size").alias("group_size"), F.col("first_doc_id").alias("group_doc_id")
    )
    # a digest alone could name the group of another text
    own = (F.col("fingerprint") == F.col("_q_digest")) & (F.col("canon_sha256") == F.col("_q_sha"))
    columns = [c for c in rows.columns if c != "canon_sha256"]
    return rows.join(found, own, "left").select(*columns, F.coalesce("group_doc_id", "doc_id").alias("group_doc_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
