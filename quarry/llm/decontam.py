"""Benchmark decontamination by a broadcast hash set of normalised test n-grams (built-in functions only).

Texts are lower-cased in A-Z and cut into words; each run of ``n`` words of a benchmark item (the whole item if it is shorter)
is a window.  The windows' 64-bit hashes are the broadcast side; every run of words of every training text is hashed inside one
generated-code stage, looked up, and a hit counts only if its words equal the window's.  Hits of a document are then united to
covered words, and documents or only the covered spans can be removed.

The broadcast side is measured first.  Beyond ``limit`` bytes the windows are dealt into blocks by hash, and each block is one
more pass over the documents, numbered and written once, with a broadcast of at most about that size; nothing of the documents is
shuffled but one row for each document and its hits, which are united to spans in one sorted pass.

Defined results: a null text, benchmark or training, has no words and no hits; repeated rows are judged one by one, also with
equal or null ids; a null item id is named as the empty string; an empty benchmark hits nothing; other columns, of any
type and name, pass through ``removed_documents`` and ``removed_spans`` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TOKEN, ascii_lower, documents, unused, written

#: Words of a window.
N = 13
#: Bytes of windows, as measured, that are broadcast at once.
LIMIT = 64 << 20


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def windows(bench: DataFrame, n: int = N, item: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows (``gram``, ``len``, hash ``h``) of the benchmark with the ids of their items."""
    words = bench.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), tokens(F.col(text)).alias("words")).filter(F.size("words") > 0)
    cut = words.select("item", "words", F.least(F.lit(n), F.size("words")).alias("len")).select("item", "words", "len", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("i"))
    grams = cut.select("item", "len", F.slice("words", F.col("i") + 1, F.col("len")).alias("gram"))
    return grams.groupBy("len", "gram").agg(F.collect_set("item").alias("items")).withColumn("h", F.xxhash64("gram"))


def hits(docs: DataFrame, bench: DataFrame, n: int = N, limit: int = LIMIT, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each row of ``docs``: ``keep``, ``n_words``, ``spans`` (covered runs of words, end exclusive, disjoint, in order), ``items``."""
    grams = written(windows(bench, n), "decontam-windows")
    size, lengths = grams.agg(F.sum(F.octet_length(F.array_join("gram", " ")) + F.octet_length(F.array_join("items", " ")) + 64), F.sort_array(F.collect_set("len"))).first()
    blocks = max(1, math.ceil((size or 0) / limit))
    own = [F.col(f"`{c}`").alias(f"_q_k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.monotonically_increasing_id().alias("_q_row"), *own, tokens(F.col(f"`{text}`")).alias("_q_words"))
    if blocks > 1:
        # each block reads the rows again: their numbers must be the same each time, whatever shuffle or lost executor they come from
        rows = written(rows, "decontam-rows")
    # position -1 stands for the document itself, which so comes through without a hit
    at = rows.select("*", F.size("_q_words").alias("_q_n"), F.explode(F.sequence(F.lit(-1), F.size("_q_words") - 1)).alias("_q_i"))
    if len(lengths or ()) > 1:
        at = at.withColumn("_q_len", F.explode(F.when(F.col("_q_i") < 0, F.array(F.lit(0))).otherwise(F.lit(list(lengths)))))
    else:
        at = at.withColumn("_q_len", F.lit(lengths[0] if lengths else n))
    gram = F.slice("_q_words", F.col("_q_i") + 1, F.col("_q_len"))
    at = at.withColumn("_q_h", F.when((F.col("_q_i") >= 0) & (F.col("_q_i") + F.col("_q_len") <= F.col("_q_n")), F.xxhash64(gram)))
    kept = [f"_q_k{i}" for i in range(len(keep))]
    parts = []
    for k in range(blocks):
        block = grams if blocks == 1 else grams.filter(F.pmod("h", F.lit(blocks)) == k)
        # equality written as two comparisons stays a check on matches; as an equality it would become part of the hash key of every position
        here = F.slice("_q_words", F.greatest(F.col("_q_i"), F.lit(0)) + 1, F.col("_q_len"))
        verified = (F.col("_q_len") >= F.col("len")) & (F.col("_q_len") <= F.col("len")) & (here >= F.col("gram")) & (here <= F.col("gram"))
        found = at.join(F.broadcast(block), (F.col("_q_h") == F.col("h")) & verified, "left")
        document = (F.col("_q_i") < 0) if k == 0 else F.lit(False)
        end = F.when(F.col("_q_i") < 0, -1).otherwise(F.col("_q_i") + F.col("_q_len")).alias("_q_to")
        # only the document's own row carries its columns
        parts.append(found.filter(F.col("h").isNotNull() | document).select("_q_row", "_q_i", end, *[F.when(F.col("_q_i") < 0, F.struct(F.col(c))).alias(c) for c in kept], F.when(F.col("_q_i") < 0, F.col("_q_n")).alias("_q_n"), "items"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # hits in order of their starts: one that starts behind all ends so far begins a span; a document's own row is span 0
    before = Window.partitionBy("_q_row").orderBy("_q_i", "_q_to")
    every = every.withColumn("_q_reach", F.max("_q_to").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    every = every.withColumn("_q_span", F.sum((F.col("_q_i") > F.col("_q_reach")).cast("int")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = every.groupBy("_q_row", F.coalesce("_q_span", F.lit(0)).alias("_q_span")).agg(
        F.min("_q_i").alias("from"), F.max("_q_to").alias("to"), *[F.first(c, ignorenulls=True).alias(c) for c in [*kept, "_q_n"]], F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    merged = spans.groupBy("_q_row").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in kept],
        F.max("_q_n").cast("long").alias("n_words"),
        F.array_sort(F.collect_list(F.when(F.col("_q_span") > 0, F.struct("from", "to")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return merged.select(*[F.col(c)[c].alias(name) for c, name in zip(kept, keep, strict=True)], "n_words", "spans", "items")


def covered(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])


def contaminated(n_hit: Column, n_words: Column, percent: int = 5) -> Column:
    return (n_hit > 0) & (100 * n_hit >= percent * n_words)


def judged(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    found = hits(docs, bench, **options)
    return found.withColumn("n_hit", covered(F.col("spans"))).withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def removed_documents(docs: DataFrame, bench: DataFrame, n: int = N, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents.

    Only the keys and text hashes of contaminated documents go to the second pass: broadcast if there are at most a million, else
    joined by a shuffle.  Equal texts have equal verdicts, so repeated rows are safe.
    """
    bad_key, bad_hash = unused(docs, "_q_key"), unused(docs, "_q_hash")
    mark = docs.select(F.col(f"`{key}`").alias("_q_key"), F.xxhash64(F.col(f"`{text}`")).alias("_q_hash"), F.col(f"`{text}`").alias("_q_text"))
    bad = written(judged(mark, bench, n=n, limit=limit, text="_q_text", keep=("_q_key", "_q_hash")).filter("contaminated").select(F.col("_q_key").alias(bad_key), F.col("_q_hash").alias(bad_hash)).distinct(), "decontam-bad")
    side = F.broadcast(bad) if bad.count() <= 1_000_000 else bad
    return docs.join(side, (F.xxhash64(F.col(f"`{text}`")) == F.col(bad_hash)) & F.col(f"`{key}`").eqNullSafe(F.col(bad_key)), "left_anti")


def removed_spans(docs: DataFrame, bench: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the covered words (and what lies between them) cut out of the texts; texts without a hit stay as they are."""
    aliased = docs.select(*[F.col(f"`{c}`").alias(f"_q_c{i}") for i, c in enumerate(docs.columns)])
    own = f"_q_c{docs.columns.index(text)}"
    found = hits(aliased, bench, text=own, keep=tuple(aliased.columns), **options)
    # a word and what follows it up to the next word, and before them what precedes the first word
    gap, letter = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col(own), F.lit(f"^{gap}+|{letter}+{gap}*"), F.lit(0))
    lead = F.when(F.col(own).rlike(f"^{gap}"), 1).otherwise(0)
    # what lies between two spans, as slices
    edges = F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("spans")["to"]).alias("a"), F.concat(F.col("spans")["from"], F.array(F.col("n_words").cast("int"))).alias("b"))
    between = F.flatten(F.transform(edges, lambda e: F.slice("_q_pieces", e["a"] + 1 + F.col("_q_lead"), e["b"] - e["a"])))
    kept = F.concat(F.array_join(F.slice("_q_pieces", F.lit(1), F.col("_q_lead")), ""), F.array_join(between, ""))
    # an exploded array of one keeps the pieces from being cut anew for each slice
    found = found.withColumn("_q_lead", lead).withColumn("_q_pieces", F.explode(F.array(F.when(F.size("spans") > 0, pieces))))
    found = found.withColumn(own, F.when(F.size("spans") > 0, kept).otherwise(F.col(own)))
    return found.select(*[F.col(f"_q_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), w AS (
  SELECT DISTINCT item, least(13, len(words)) AS n, words[i : i + least(13, len(words)) - 1] AS gram
  FROM (SELECT item, words, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) AS i FROM b WHERE len(words) > 0)
), n AS (SELECT DISTINCT n FROM w),
g AS (
  SELECT doc_id, i, n, words[i : i + n - 1] AS gram FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM d, n WHERE len(words) >= n)
), h AS (
  SELECT g.doc_id, g.i, g.n, w.item FROM g JOIN w ON g.gram = w.gram AND g.n = w.n
), c AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
