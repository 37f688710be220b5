"""A deterministic encoder: k-mers as filters.

It has the output contract of a learned sparse encoder, events (seq, position, fil, mag), and stands in for one; it is a
substitute of function, not an equivalent.  Each k-mer is hashed to a filter, its magnitude is the logarithm of how much more often it
occurs in real than in shuffled sequences, and each sequence keeps its top events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from .encode import shuffled
from .patterns import top_q


def kmers(sequences: DataFrame, k: int) -> DataFrame:
    """(seq_id, position, word) of all words of k letters."""
    places = F.sequence(F.lit(1), F.length("seq") - k + 1)
    return sequences.filter(F.length("seq") >= k).select("seq_id", "seq", F.explode(places).alias("position")).select("seq_id", "position", F.substring("seq", F.col("position"), F.lit(k)).alias("word"))


def encode(sequences: DataFrame, config=DEFAULT) -> DataFrame:
    """The code of all sequences: (seq, position, fil, mag, tie)."""
    k = config.filter_len
    real = kmers(sequences, k)
    counts = real.groupBy("word").agg(F.count("*").alias("fg"))
    fake = kmers(shuffled(sequences), k).groupBy("word").agg(F.count("*").alias("bg"))
    # words enriched at least twofold; at most 4 ** k rows
    gain = counts.join(fake, "word", "left").select("word", F.log2((F.col("fg") + 1) / (F.coalesce("bg", F.lit(0)) + 1)).alias("mag")).filter("mag > 1")
    fil = F.pmod(F.xxhash64("word"), F.lit(config.filters)).cast("int")
    events = real.join(F.broadcast(gain), "word").select(F.col("seq_id").alias("seq"), F.col("position").cast("int").alias("position"), fil.alias("fil"), "mag", F.col("word").alias("tie"))
    return top_q(events, config.sparsity)
