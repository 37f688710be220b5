"""Count, frequency and weight matrices in long form: (motif_id, offset, base, value), offsets from 1, four rows an offset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULT
from ..tables import gathered
from .encode import BASES, coded
from .encode import by_length as grouped

FLAT = {b: 0.25 for b in BASES}


def windows(hits: DataFrame, sequences: DataFrame) -> DataFrame:
    """``hits(motif_id, seq_id, pos, comp, len)`` with ``word``, the letters there, reverse-complemented on the other strand; hits
    out of bounds are dropped.

    Hits are many and short, so what Spark takes for a small table fills a driver: neither side is sent to all tasks.
    """
    own = hits.hint("merge").join(sequences.select("seq_id", "seq"), "seq_id").filter((F.col("pos") >= 1) & (F.col("pos") + F.col("len") - 1 <= F.length("seq")))
    word = F.substring("seq", F.col("pos"), F.col("len"))
    return own.withColumn("word", F.when(F.col("comp"), F.translate(F.reverse(word), "ACGT", "TGCA")).otherwise(word)).drop("seq")


#: Counts that a task holds before it hands them on, in bytes.
HELD = 1 << 26


def count_matrix(words: DataFrame) -> DataFrame:
    """(motif_id, offset, base, cnt) of aligned words (motif_id, word).  Words are counted letter by letter, and a task hands on its sums when it is done or they
    fill ``HELD``: a batch of words of a thousand motifs has more counts than letters."""

    def rows(held: dict[int, tuple[dict, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for size, (motifs, cells) in held.items():
            names = pa.array(list(motifs), kind)
            for at in range(0, len(motifs), 1024):
                own = cells[at : min(at + 1024, len(motifs))]
                at_motif = pa.array(np.repeat(np.arange(at, at + len(own)), size))
                offsets = np.tile(np.arange(1, size + 1, dtype=np.int32), len(own))
                yield pa.RecordBatch.from_arrays([names.take(at_motif), pa.array(offsets), *[pa.array(own[:, :, i].ravel()) for i in range(4)]], ["motif_id", "offset", *BASES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[dict, np.ndarray]] = {}
        for batch in gathered(batches):
            part = batch.filter(batch.column(1).is_valid())
            for own, points in grouped(part.column(1).to_pylist()):
                size = points.shape[1]
                if not size:
                    continue
                kinds = part.column(0).take(pa.array(own)).dictionary_encode(null_encoding="encode")
                at = kinds.indices.to_numpy()[:, None] * size + np.arange(size)
                cells = np.bincount((at * 5 + coded(points)).ravel(), minlength=5 * size * len(kinds.dictionary)).reshape(-1, size, 5)[:, :, :4]
                motifs, sums = held.get(size, ({}, np.zeros((0, size, 4), np.int64)))
                places = [motifs.setdefault(m, len(motifs)) for m in kinds.dictionary.to_pylist()]
                if len(motifs) > len(sums):
                    sums = np.concatenate([sums, np.zeros((max(len(motifs), 2 * len(sums)) - len(sums), size, 4), np.int64)])
                sums[places] += cells
                held[size] = motifs, sums
            if sum(c.nbytes for _, c in held.values()) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    own = words.select("motif_id", "word")
    kind = to_arrow_type(own.schema["motif_id"].dataType)
    return summed_cells(own.mapInArrow(run, f"motif_id {own.schema['motif_id'].dataType.simpleString()}, offset int, " + ", ".join(f"{b} bigint" for b in BASES)))


def summed_cells(some: DataFrame) -> DataFrame:
    """(motif_id, offset, base, cnt) from partial sums (motif_id, offset, A, C, G, T)."""
    cells = some.groupBy("motif_id", "offset").agg(*[F.sum(b).alias(b) for b in BASES])
    return cells.select("motif_id", "offset", F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(b).alias("cnt")) for b in BASES])).alias("x")).select("motif_id", "offset", "x.base", "x.cnt")


def frequency_matrix(counts: DataFrame, ps: float = DEFAULT.ps_freq) -> DataFrame:
    """``freq``: (cnt + ps) / (column sum + 4 ps)."""
    column = Window.partitionBy("motif_id", "offset")
    return counts.withColumn("freq", (F.col("cnt") + F.lit(ps)) / (F.sum("cnt").over(column) + F.lit(4 * ps)))


def flat(base: Column, background: dict[str, float] | None = None) -> Column:
    bg = background or FLAT
    out = F.lit(None).cast("double")
    for b in BASES:
        out = F.when(base == b, F.lit(bg[b])).otherwise(out)
    return out


def weight_matrix(freqs: DataFrame, background: dict[str, float] | None = None) -> DataFrame:
    """``weight``: log2 of the frequency over the background's."""
    return freqs.withColumn("weight", F.log2(F.col("freq") / flat(F.col("base"), background)))


def information(counts: DataFrame, ps: float = DEFAULT.ps_ic, background: dict[str, float] | None = None) -> DataFrame:
    """(motif_id, offset, ic): sum of f log2(f / background) of each column."""
    f = frequency_matrix(counts, ps)
    return f.groupBy("motif_id", "offset").agg(F.sum(F.col("freq") * F.log2(F.col("freq") / flat(F.col("base"), background))).alias("ic"))


def information_of(weights: DataFrame) -> DataFrame:
    """(motif_id, offset, ic) from frequencies and weights."""
    return weights.groupBy("motif_id", "offset").agg(F.sum(F.col("freq") * F.col("weight")).alias("ic"))


def extreme_scores(weights: DataFrame) -> DataFrame:
    """(motif_id, best, worst): sums of the columns' largest and smallest weights."""
    columns = weights.groupBy("motif_id", "offset").agg(F.max("weight").alias("hi"), F.min("weight").alias("lo"))
    return columns.groupBy("motif_id").agg(F.sum("hi").alias("best"), F.sum("lo").alias("worst"))


def moving_average(ic: DataFrame, width: int = DEFAULT.ic_window) -> DataFrame:
    """``avg_ic``: the centred mean, over fewer columns at the edges."""
    around = Window.partitionBy("motif_id").orderBy("offset").rowsBetween(-(width // 2), width // 2)
    return ic.withColumn("avg_ic", F.avg("ic").over(around))


def high_segments(ic: DataFrame, least: float = DEFAULT.ic_effective, width: int = DEFAULT.ic_window) -> DataFrame:
    """(motif_id, start, end): maximal runs of columns whose averaged information is above ``least``."""
    high = moving_average(ic, width).filter(F.col("avg_ic") > least)
    island = F.col("offset") - F.row_number().over(Window.partitionBy("motif_id").orderBy("offset"))
    return high.withColumn("_g", island).groupBy("motif_id", "_g").agg(F.min("offset").alias("start"), F.max("offset").alias("end")).drop("_g")


def longest_segment(segments: DataFrame) -> DataFrame:
    return segments.groupBy("motif_id").agg(F.max(F.col("end") - F.col("start") + 1).alias("longest"))


def kept(frame: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows of the motifs that ``mask(motif_id, keep)`` keeps; motifs it doesn't name go."""
    return frame.join(mask.filter("keep").select("motif_id").distinct(), "motif_id", "left_semi")


def without(frame: DataFrame, motifs: DataFrame) -> DataFrame:
    """Rows of all motifs but those of ``motifs(motif_id)``."""
    return frame.join(motifs.select("motif_id").distinct(), "motif_id", "left_anti")


def by_length(counts: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """(matrices of ``low`` to ``high`` columns, all others)."""
    inside = counts.groupBy("motif_id").agg(F.max("offset").alias("len")).filter(F.col("len").between(low, high)).select("motif_id")
    return counts.join(inside, "motif_id", "left_semi"), counts.join(inside, "motif_id", "left_anti")


def with_segments(frame: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows of motifs that have a high segment."""
    return frame.join(segments.select("motif_id").distinct(), "motif_id", "left_semi")
