"""Mixing sources to target weights by Efraimidis-Spirakis sampling (built-in functions only).

Each source has a target number of words.  A target of k + f times the source's size takes every document k times (complete
epochs) and then a weighted sample without replacement of about the fraction f: each document draws ``-ln(u) / w`` from a hash
of its key, w being its quality weight, the smallest keys come first, and documents are taken while the running sum of their
sizes stays nearest the rest of the budget.

The running sum needs no single-task sort of a hot source: keys are cut into buckets of equal probability, the sums of buckets
(one row for each source and bucket) are prefix-summed, and rows are sorted only inside a source's bucket.  Sources, one row each,
meet in one task to share their excess.

Defined results: a null or blank text has size 0 and is taken 0 times as words; it is copied as often as complete epochs pass
over its source, and with the fraction where its key is early; null sources form one source, the last; a null key hashes as the
empty string; equal keys are ordered by the document key and size, and identical rows are interchangeable; an empty table gives
an empty table.  Sources are gathered as one row each, never their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, masked, written

#: Weights of sources in code-point order, repeating; a target stops at so many times its source's size.
WEIGHTS, MOST = (1.0, 2.0, 3.0), 3
SEED = "mix-1"
#: Rows of a source that one bucket holds on average.
PER_BUCKET = 4_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)``, a row a source, with ``target``: weights share the total, no target above ``most`` sizes.

    Sharing the excess again until no target is too high ends at min(most * size, level * weight), with the one level at which
    targets sum to the total.  Sources sorted by the level at which they fill up, the first that stays below its bound when all
    earlier ones are full has the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    with_w = sizes.withColumn("_q_w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("_q_cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("_q_cap") / F.col("_q_w"), F.col("source").asc_nulls_last())
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("_q_cap").over(before), F.lit(0.0))) / F.sum("_q_w").over(onward)
    leveled = with_w.withColumns({"_q_level": level, "_q_at": F.row_number().over(fill)})
    fits = F.when(F.col("_q_level") <= F.col("_q_cap") / F.col("_q_w"), F.struct(F.col("_q_at"), F.col("_q_level")))
    found = leveled.withColumn("_q_first", F.min(fits).over(Window.partitionBy()))
    return found.select("source", "source_size", F.round(F.least(F.col("_q_cap"), F.coalesce(F.col("_q_first")["_q_level"] * F.col("_q_w"), F.col("_q_cap"))), 6).alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from a hash of the key, the same on each run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 48))


def quality(size: Column) -> Column:
    """The default quality weight: documents under a few dozen words count for less; from 0.5 to 1."""
    return F.lit(0.5) + size / (F.lit(2.0) * (size + F.lit(32.0)))


def mixed(sizes: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, weight=quality) -> DataFrame:
    """(key, source, size, source_size, target, epochs, draw, chosen, copies) for each row of ``sizes``, in columns of the first three names
    and of ``_q_`` and the others': how often the mix takes it.

    Rows that are equal in the three are one until the end, with their number, so a key that many rows share is one row in a bucket.
    """
    df = sizes.groupBy(F.col(key).alias("_q_key"), F.col(source).alias("_q_source"), F.col(size).alias("_q_size")).agg(F.count("*").alias("_q_n"))
    words_of = F.col("_q_size") * F.col("_q_n")
    tall = df.groupBy(F.col("_q_source").alias("source")).agg(F.sum(words_of).alias("source_size"), F.count("*").alias("_q_rows"))
    # a row a source
    tall = written(tall, "mix-sources")
    table = targets(tall.select("source", "source_size"), weights, most).select(F.col("source").alias("_q_of"), F.col("source_size").alias("_q_source_size"), F.col("target").alias("_q_target"))
    counts = tall.select(F.col("source").alias("_q_of2"), F.greatest(F.lit(1), F.ceil(F.col("_q_rows") / PER_BUCKET)).cast("int").alias("_q_buckets"))
    table = table.join(counts, F.col("_q_of").eqNullSafe(F.col("_q_of2"))).drop("_q_of2")
    draw = -F.log(uniform(F.col("_q_key"), seed)) / weight(F.col("_q_size"))
    rows = df.join(table, F.col("_q_source").eqNullSafe(F.col("_q_of"))).withColumn("_q_draw", draw)
    # the draw's own distribution for weight 1, so that buckets in order of the draw are about even
    rows = rows.withColumn("_q_bucket", F.least(F.col("_q_buckets") - 1, F.floor((F.lit(1.0) - F.exp(-F.col("_q_draw"))) * F.col("_q_buckets")).cast("int")))
    sums = rows.groupBy(F.col("_q_source").alias("_q_s"), F.col("_q_bucket").alias("_q_b")).agg(F.sum(words_of).alias("_q_sum"))
    sums = sums.withColumn("_q_base", F.coalesce(F.sum("_q_sum").over(Window.partitionBy("_q_s").orderBy("_q_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(sums.select("_q_s", "_q_b", "_q_base"), F.col("_q_source").eqNullSafe(F.col("_q_s")) & (F.col("_q_bucket") == F.col("_q_b")))
    inside = Window.partitionBy("_q_source", "_q_bucket").orderBy("_q_draw", "_q_key", "_q_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_q_before", F.col("_q_base") + F.coalesce(F.sum(words_of).over(inside), F.lit(0)))
    epochs = F.when(F.col("_q_source_size") > 0, F.floor(F.col("_q_target") / F.col("_q_source_size"))).otherwise(F.lit(1)).cast("long")
    rest = F.col("_q_target") - epochs * F.col("_q_source_size")
    # each of equal rows in turn
    rows = rows.withColumn("_q_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_q_n"))))
    chosen = (F.col("_q_before") + (F.col("_q_i") - 1) * F.col("_q_size") + F.col("_q_size") / 2.0 <= rest) & (rest > 0)
    copies = F.least(F.lit(most), epochs + chosen.cast("long")).cast("long")
    return rows.select(F.col("_q_key").alias(key), F.col("_q_source").alias(source), F.col("_q_size").alias(size), "_q_source_size", "_q_target", epochs.alias("_q_epochs"), "_q_draw", chosen.alias("_q_chosen"), copies.alias("_q_copies"))


def copied(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, weight=quality, **options) -> DataFrame:
    """The mix itself: each row of ``df`` as often as the mix takes it, with the columns of ``df``.

    What a source's fraction takes is a prefix in the order of draws, as the running sum grows by at least half of each size.  So
    the sort is over keys and sizes only, and rows with their texts are held against their source's last taken draw, without a
    shuffle; rows that equal it in draw, key and size are all taken.
    """
    df, (key, text, source), back = masked(df, key, text, source)
    place = lambda size: F.struct((-F.log(uniform(F.col(f"`{key}`"), seed)) / weight(size)).alias("draw"), F.col(f"`{key}`").isNotNull().alias("some"), F.col(f"`{key}`").alias("key"), size.alias("size"))
    narrow = written(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), words(F.col(f"`{text}`")).alias("size")), "mix-sizes")
    own = mixed(narrow, key="key", source="source", size="size", seed=seed, weight=weight, **options)
    last = F.max(F.when(F.col("_q_chosen"), F.struct(F.col("_q_draw").alias("draw"), F.col("key").isNotNull().alias("some"), "key", "size")))
    ends = written(own.groupBy(F.col("source").alias("_q_source")).agg(F.max("_q_epochs").alias("_q_epochs"), last.alias("_q_last")), "mix-ends")
    # a row a source
    side = F.broadcast(ends) if ends.count() <= 1_000_000 else ends
    rows = df.join(side, F.col(f"`{source}`").eqNullSafe(F.col("_q_source")))
    # an exploded array of one keeps the count from being inlined, and so repeated, wherever it is used
    rows = rows.withColumn("_q_size", F.explode(F.array(words(F.col(f"`{text}`")))))
    taken = F.col("_q_epochs") + F.coalesce((place(F.col("_q_size")) <= F.col("_q_last")).cast("int"), F.lit(0))
    rows = rows.withColumn("_q_copies", F.least(F.lit(options.get("most", MOST)), taken).cast("int")).filter("_q_copies > 0")
    return back(rows.withColumn("_q_copy", F.explode(F.sequence(F.lit(1), F.col("_q_copies")))))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    # texts are read once; the mix then works on three narrow columns
    sizes = written(documents(spark, sf_dir).select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes")
    rows = mixed(sizes)
    return rows.select("doc_id", "size", F.col("_q_source_size").alias("source_size"), F.col("_q_target").alias("target"), (F.col("_q_copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, row_number() OVER o AS place,
    ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, encode(source) ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, encode(source) ASC NULLS LAST)
), t AS (
  SELECT source, source_size, round(least(cap, coalesce((SELECT min_by(level, place) FROM l WHERE level <= cap / weight) * weight, cap)), 6)::DOUBLE AS target FROM l
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / (0.5 + d.size / (2.0::DOUBLE * (d.size + 32.0::DOUBLE))) AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 1 END::BIGINT AS epochs FROM k
)
SELECT doc_id, size, source_size, target,
  (least(3, epochs + CASE WHEN before + size / 2.0::DOUBLE <= target - epochs * source_size AND target - epochs * source_size > 0 THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM b
"""
