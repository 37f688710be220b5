"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import dropped, released, shared_dir, small_batches, written

__all__ = ["LOWER", "TOKEN", "UPPER", "WORD", "ascii_lower", "deleted", "documents", "dropped", "masked", "partitions", "released", "scratch", "shared_dir", "small_batches", "unused", "written"]

#: A-Z to a-z and nothing else; ``lower`` would also change other scripts.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of digits, small letters and everything beyond ASCII: what `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` matches, written without a negation,
#: which Java matches many times slower.
TOKEN = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Runs of anything but ASCII white space: `[^\x20\x09-\x0D]+`.
WORD = r"[\x00-\x08\x0E-\x1F\x21-\x{10FFFF}]+"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, label: str) -> str:
    """The name of a new folder in the shared one, for files that tasks write themselves."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def deleted(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def masked(df: DataFrame, *columns: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """(``df`` with columns named by their places, so that helpers can't clash with them; the names of ``columns`` there; a function that
    takes a table's columns of ``df`` and gives them their own names again)."""
    places = [f"_q_c{i}" for i in range(len(df.columns))]
    own = dict(zip(df.columns, places, strict=True))
    return df.toDF(*places), [own[c] for c in columns], lambda out: out.select(*places).toDF(*df.columns)
