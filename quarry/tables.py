"""Intermediate tables that survive lost executors and cut the lineage of iterative plans."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch between the JVM and Python, so that long rows don't add up.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``ARROW`` where they are larger."""
    for key, most in ARROW.items():
        try:
            now = int(str(spark.conf.get(key)).rstrip("bB"))
        except Exception:  # a Spark without this setting, or one with a unit
            continue
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Short rows in batches of about ``rows``: for steps that hand on sums of a batch."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Unset, a temporary folder serves a local master only; on a cluster that is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    got = spark.conf.get("spark.quarry.local.scratch", None) or tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.quarry.local.scratch", got)
    return got


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quarry_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "quarry_path", None):
            spark = t.sparkSession
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does so when the driver's objects for them are collected, which a
    driver with memory to spare may not do for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
