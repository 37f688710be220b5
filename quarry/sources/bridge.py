"""The driver's tables as inputs of this domain: ``documents`` as sequences, ``lineitem`` as encoder events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import small_batches

#: Length of a sequence, and ids that a document may have.
LENGTH, PER_DOCUMENT = 60, 1 << 20


#: What is left of a text's bytes, and their capitals.
_UPPER = bytes.maketrans(b"acgt", b"ACGT")
_OTHER = bytes(set(range(256)) - set(b"ACGTacgt"))


def sequences(spark: SparkSession, sf_dir: str, length: int = LENGTH) -> DataFrame:
    """(seq_id, seq): the letters A, C, G, T of each whole text, cut into consecutive sequences of equal length; a rest that is
    shorter is dropped, as sequences have one length."""
    small_batches(spark)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # no byte of a longer UTF-8 character is a letter
            letters = [(t or b"").translate(_UPPER, _OTHER) for t in batch.column(1).to_pylist()]
            n = np.array([len(s) // length for s in letters], np.int64)
            whole = b"".join(s[: k * length] for s, k in zip(letters, n.tolist(), strict=True))
            total = int(n.sum())
            seq = pa.StringArray.from_buffers(total, pa.py_buffer(np.arange(0, (total + 1) * length, length, dtype=np.int32)), pa.py_buffer(whole))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.arange(total) - np.repeat(np.cumsum(n) - n, n)), seq], ["doc_id", "i", "seq"])

    cut = texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, i long, seq string")
    return cut.select((F.col("doc_id") * PER_DOCUMENT + F.col("i")).alias("seq_id"), "seq")


SEQUENCES_SQL = f"""
letters AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS s FROM documents),
sequences AS (
  SELECT doc_id * {PER_DOCUMENT} + i AS seq_id, substr(s, i * {LENGTH} + 1, {LENGTH}) AS seq
  FROM (SELECT doc_id, s, unnest(range(0, length(s) // {LENGTH})) AS i FROM letters)
)"""


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, position, fil, mag, tie): encoder events; ``tie`` orders events with equal position and filter."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("int").alias("position"), (F.col("l_suppkey") % 4).cast("int").alias("fil"), F.col("l_quantity").cast("double").alias("mag"), F.struct("l_partkey", "l_quantity", "l_extendedprice").alias("tie")
    )


CODE_SQL = """
code AS (
  SELECT l_orderkey AS seq, l_linenumber::INTEGER AS position, (l_suppkey % 4)::INTEGER AS fil, l_quantity::DOUBLE AS mag, l_partkey AS t1, l_quantity AS t2, l_extendedprice AS t3 FROM lineitem
)"""
