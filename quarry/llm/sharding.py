"""Sharding by a Feistel permutation with cycle walking over global row numbers (built-in functions only).

Rows are numbered 0..N-1 in the order of a key, the number goes through a keyed bijection of [0, N), and the image p gives
shard ``p % shards`` and slot ``p div shards``.  So shard sizes differ by one row at most, slots have no gaps, and anyone who
knows N, the seed and a row number can compute where the row is without looking at the data.

Nothing is gathered: the numbering range-partitions the rows by key and ties, which splits a key that holds many of them, sorts each
partition and writes them with their places; only the counts of the partitions meet, one row each.

Defined results: a null key sorts first; rows with equal keys are ordered by the text's CRC and then its length (identical
rows are interchangeable); a null text is empty; an empty table gives an empty table; every input column is carried along.  Helper
columns avoid the input's names, and a result column whose name the input has gets underscores before its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, partitions, unused, written

#: Fixed constants of the round function.
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263, 374761393, 1181783497)
PRIME = 2305843009213693951


def numbered(df: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = (), out: str = "row_number") -> DataFrame:
    """Adds the 0-based position of each row in the order of ``key`` (nulls first), then ``ties``, without a single-task sort.

    The sorted partitions are written once: their bounds come from a sample, so that places and counts must be of one run.
    """
    at, part, start = (unused(df, n) for n in ("_q_at", "_q_part", "_q_start"))
    order = [F.col(f"`{key}`").asc_nulls_first(), *[F.col(f"`{t}`").asc_nulls_first() for t in ties]]
    # an id has the partition above its 33rd bit and the place in the sorted partition below it
    rows = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = written(rows, "numbered")
    counts = rows.groupBy(F.shiftright(F.col(at), 33).alias(part)).agg(F.count("*").alias(start))
    # one row a partition
    starts = counts.select(part, F.coalesce(F.sum(start).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start))
    placed = rows.withColumn(part, F.shiftright(F.col(at), 33)).join(F.broadcast(starts), part)
    return placed.withColumn(out, F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).select(*[f"`{c}`" for c in df.columns], out)


def feistel(x: Column, left: int, right: int, seed: int, rounds: int = 6) -> Column:
    """A keyed bijection of [0, left * right): the halves ``x % left`` and ``x div left`` are shifted in turn by a hash of the other."""

    def mixed(half: Column, i: int) -> Column:
        y = (half * F.lit(MULTIPLIERS[i % len(MULTIPLIERS)]) + F.lit((seed * 1_000_003 + i * 7_919) % PRIME)) % F.lit(PRIME)
        return F.shiftright((y.bitwiseXOR(F.shiftright(y, 15)) % F.lit(1 << 40)) * F.lit(4194301), 20)

    # the difference is a multiple of left, so the division is exact while the quotient is below 2**53
    state = F.struct((x % F.lit(left)).cast("long").alias("lo"), ((x - x % F.lit(left)) / F.lit(left)).cast("long").alias("hi"))
    for i in range(rounds):
        # transform over a one-element array names the intermediate state, which would otherwise be repeated exponentially often
        state = F.transform(F.array(state), _round(i, left, right, mixed))[0]
    return F.transform(F.array(state), lambda s: s["hi"] * F.lit(left) + s["lo"])[0]


def _round(i: int, left: int, right: int, mixed):
    if i % 2 == 0:
        return lambda s: F.struct(((s["lo"] + mixed(s["hi"], i)) % F.lit(left)).alias("lo"), s["hi"].alias("hi"))
    return lambda s: F.struct(s["lo"].alias("lo"), ((s["hi"] + mixed(s["lo"], i)) % F.lit(right)).alias("hi"))


def permuted(df: DataFrame, number: str, n: int, seed: int, out: str) -> DataFrame:
    """Adds the image of the column ``number`` under a keyed bijection of [0, n).

    The Feistel domain left * right is the least of its shape that holds n, so at most ``left - 1`` numbers, under the square root of n,
    lie outside.  These are walked until all are inside, each a row of a table; a row whose first image is outside looks its end
    up there.
    """
    left = max(1, math.isqrt(max(0, n - 1)) + 1)
    right = max(1, -(-n // left))
    outside, end = unused(df, "_q_outside"), unused(df, "_q_end")
    spark = df.sparkSession
    walks = spark.range(n, left * right).select(F.col("id").alias(outside), feistel(F.col("id"), left, right, seed).alias(end))
    # a walk that comes back to its start never was inside, so nothing inside leads to it
    while not (walks := walks.filter(F.col(end) != F.col(outside))).filter(F.col(end) >= n).isEmpty():
        walks = written(walks.select(outside, F.when(F.col(end) < n, F.col(end)).otherwise(feistel(F.col(end), left, right, seed)).alias(end)), "walks")
    df = df.withColumn(out, feistel(F.col(number), left, right, seed))
    # under sqrt(n) rows
    df = df.join(F.broadcast(walks), F.col(out) == F.col(outside), "left")
    return df.withColumn(out, F.coalesce(F.col(end), F.col(out))).drop(outside, end)


def sharded(df: DataFrame, shards: int, seed: int = 17, key: str = "doc_id", ties: tuple[str, ...] = (), shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds ``shard`` int and ``slot`` long to each row of ``df``: law `rows`, counts at most one apart.

    If ``df`` has a column of such a name, the new one gets underscores before its own.
    """
    row, image, shard, slot = (unused(df, n) for n in ("_q_row", "_q_image", shard, slot))
    rows = numbered(df, key, ties, out=row)
    rows = permuted(rows, row, rows.count(), seed, image)
    return rows.withColumns({shard: (F.col(image) % shards).cast("int"), slot: F.expr(f"{image} div {int(shards)}").cast("long")}).drop(row, image)


def op8(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """Places of all documents in ``shards`` shards, by law `rows`."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharded(docs, shards, ties=("text_crc32", "size")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
