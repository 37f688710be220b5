"""FASTA sources: a record reader, and readers for float and integer labels in the header.

Files are split by Spark's text source at a line that begins with ``>``, so a file is read in parallel, records never pass the driver, and a
header may hold ``>``.  Records are numbered in the order of files (by path) and of places in them: each split counts its records, and
the counts before a split, a row for each of them, are added to the record's place in its own.  So numbers, and what follows from them (train
and test, shuffles, reports), don't depend on how files are split.

Defined results: blank records and text before the first ``>`` are no records; a header without sequence has an empty body; ``\\r`` is
dropped; an empty file has no records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def records(spark: SparkSession, path: str) -> DataFrame:
    """(number, file, header, body, first_line): ``number`` counts all records from 1, and what stands before a file's first one; ``body`` has its lines joined."""
    place = F.monotonically_increasing_id()
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("place"))
    # the text before a file's first mark is a record only if that is its first letter
    opening = F.col("block") == 0
    split = raw.groupBy("file", "block").agg(F.min("place").alias("lo"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each split of the input, about 100 bytes: 100 TB in splits of 128 MB are some 80 MB
    base = split.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "lo", F.coalesce(before, F.lit(0)).alias("base"))
    own = raw.join(F.broadcast(base), (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")))
    first = opening & (F.col("place") == F.col("lo"))
    own = own.filter(~first | F.startswith("value", F.lit(">"))).withColumn("value", F.when(first, F.substring("value", 2, 2147483647)).otherwise(F.col("value")))
    own = own.filter(F.length(F.trim(F.col("value"))) > 0)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    return own.select((F.col("base") + F.col("place") - F.col("lo") + 1).alias("number"), "file", F.trim(lines[0]).alias("header"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "").alias("body"), F.trim(F.try_element_at(lines, F.lit(2))).alias("first_line"))


def read_fasta(spark: SparkSession, path: str, max_entries: int | None = None) -> DataFrame:
    """(seq_id, header, seq) in file order: records with N are dropped, the first ``max_entries`` are kept if a number is given, then those whose length is
    the first one's; letters become upper case.  ``seq_id`` is the record's number among all of its files; with a cap, that among the kept ones."""
    clean = records(spark, path).filter(~F.col("body").contains("N") & ~F.col("body").contains("n") & (F.length("body") > 0))
    if max_entries is not None:
        clean = clean.orderBy("number").limit(max_entries)
    first = clean.agg(F.min_by(F.length("body"), "number").alias("n"))
    kept = clean.join(F.broadcast(first), F.length("body") == F.col("n"))
    # at most ``max_entries`` rows are numbered anew
    number = F.col("number") if max_entries is None else F.row_number().over(Window.orderBy("number")).cast("long")
    return kept.select(number.alias("seq_id"), "header", F.upper("body").alias("seq"))


def read_regression(spark: SparkSession, path: str) -> DataFrame:
    """(seq, label double): the header is a number and only the first line of a record is its sequence."""
    return records(spark, path).select(F.upper("first_line").alias("seq"), F.expr("try_cast(header AS double)").alias("label")).filter("label IS NOT NULL")


def read_classification(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """(seq, label int, onehot array<int>): a place of ``onehot`` for each label, in order.  At most ``most`` labels are gathered."""
    rows = records(spark, path).select(F.upper("first_line").alias("seq"), F.expr("try_cast(header AS int)").alias("label")).filter("label IS NOT NULL")
    labels = sorted(r.label for r in rows.select("label").distinct().limit(most + 1).collect())
    if len(labels) > most:
        raise ValueError(f"more than {most} labels")
    return rows.withColumn("onehot", F.transform(F.array(*[F.lit(x) for x in labels]), lambda x: (x == F.col("label")).cast("int")))


def from_strings(spark: SparkSession, strings: list[str]) -> DataFrame:
    """(seq_id, seq) from strings in memory."""
    return spark.createDataFrame([(i + 1, s.upper()) for i, s in enumerate(strings)], "seq_id bigint, seq string")
