"""SVG drawings of a report: letter stacks of matrices, and bars of how motifs' hits overlap.

Both are laid out by DataFrame operations, a row for each letter or bar, and a motif's drawing is the concatenation of its rows; the
finished drawings, one small text a motif of the report, are written as files beside its page.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..operators.matrices import information

#: Pixels of a column and of one bit, and of a bar and of a Jaccard index of 1.
COLUMN, BIT, BAR, UNIT = 20, 60, 14, 160
#: Colours of the letters, and what share of its size a capital is high and wide in the drawing's font.
COLOURS = {"A": "#2e8b57", "C": "#1f4e9c", "G": "#d98e04", "T": "#b22222"}
CAPITAL, WIDE = 0.72, 0.70
FONT = "font-family='Arial, Helvetica, sans-serif' font-weight='bold'"


def letters(counts: DataFrame, ps: float = DEFAULT.ps_ic) -> DataFrame:
    """(motif_id, offset, base, height, bottom) in bits: each letter's share of its column's information, stacked from the rarest up; equal
    shares in the order of the alphabet from the top."""
    ic = information(counts, ps).withColumnRenamed("motif_id", "_m").withColumnRenamed("offset", "_o")
    column = Window.partitionBy("motif_id", "offset")
    own = counts.withColumn("share", (F.col("cnt") + F.lit(ps)) / (F.sum("cnt").over(column) + F.lit(4 * ps)))
    own = own.join(ic, (F.col("motif_id") == F.col("_m")) & (F.col("offset") == F.col("_o"))).withColumn("height", F.col("share") * F.greatest("ic", F.lit(0.0)))
    under = column.orderBy("share", F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
    return own.select("motif_id", "offset", "base", "height", F.coalesce(F.sum("height").over(under), F.lit(0.0)).alias("bottom"))


def turned(stacks: DataFrame) -> DataFrame:
    """The stacks of the other strand."""
    last = Window.partitionBy("motif_id")
    return stacks.withColumns({"offset": F.max("offset").over(last) + 1 - F.col("offset"), "base": F.translate("base", "ACGT", "TGCA")})


def _number(c: Column) -> Column:
    return F.round(c, 3).cast("string")


def logos(stacks: DataFrame) -> DataFrame:
    """(motif_id, svg) of :func:`letters`; letters under a hundredth of a bit are left out."""
    shown = stacks.filter(F.col("height") >= 0.01)
    colour = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    text = F.concat(
        F.lit(f"<text {FONT} font-size='10' fill='"), colour[F.col("base")], F.lit("' transform='translate("), _number((F.col("offset") - 1) * COLUMN + 1), F.lit(","), _number((F.lit(2.0) - F.col("bottom")) * BIT),
        F.lit(f") scale({(COLUMN - 2) / (10 * WIDE):.3f},"), _number(F.col("height") * BIT / (10 * CAPITAL)), F.lit(")'>"), F.col("base"), F.lit("</text>"),
    )
    parts = shown.groupBy("motif_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "bottom", "base", text.alias("t")))), lambda x: x.t), "").alias("parts"))
    width = stacks.groupBy("motif_id").agg(F.max("offset").alias("n")).join(parts, "motif_id", "left")
    size = (F.col("n") * COLUMN).cast("string")
    svg = F.concat(F.lit("<svg xmlns='http://www.w3.org/2000/svg' width='"), size, F.lit(f"' height='{2 * BIT}' viewBox='0 0 "), size, F.lit(f" {2 * BIT}'>"), F.coalesce("parts", F.lit("")), F.lit("</svg>"))
    return width.select("motif_id", svg.alias("svg"))


def bars(ranked: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(motif_id, other, place, jaccard): for each motif of ``ranked(motif_id, rank)`` the others that its hits meet, at their rank's place without its own."""
    both = overlaps.select("i", "j", "jaccard").unionByName(overlaps.select(F.col("j").alias("i"), F.col("i").alias("j"), "jaccard"))
    one, two = (ranked.select(F.col("motif_id").alias(m), F.col("rank").alias(r)) for m, r in (("i", "ri"), ("j", "rj")))
    return both.join(one, "i").join(two, "j").select(F.col("i").alias("motif_id"), F.col("j").alias("other"), (F.col("rj") - (F.col("rj") > F.col("ri")).cast("int")).alias("place"), "jaccard")


def bar_charts(ranked: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(motif_id, svg): bars from 0 to 1; motifs that meet no other have empty charts."""
    n = ranked.agg(F.greatest(F.count("*") - 1, F.lit(1)).alias("n"))
    bar = F.concat(
        F.lit("<rect stroke='black' fill='#888' x='"), _number((F.col("place") - 1) * BAR + 2), F.lit("' y='"), _number(UNIT * (1 - F.col("jaccard"))), F.lit(f"' width='{BAR - 4}' height='"), _number(UNIT * F.col("jaccard")),
        F.lit("'><title>D"), F.col("r").cast("string"), F.lit(": "), F.round("jaccard", 3).cast("string"), F.lit("</title></rect>"),
    )
    rows = bars(ranked, overlaps).join(ranked.select(F.col("motif_id").alias("other"), F.col("rank").alias("r")), "other")
    parts = rows.groupBy("motif_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", bar.alias("t")))), lambda x: x.t), "").alias("parts"))
    size = (F.col("n") * BAR).cast("string")
    svg = F.concat(F.lit("<svg xmlns='http://www.w3.org/2000/svg' width='"), size, F.lit(f"' height='{UNIT}' viewBox='0 0 "), size, F.lit(f" {UNIT}'><path stroke='black' d='M0 {UNIT} H"), size, F.lit("'/>"), F.coalesce("parts", F.lit("")), F.lit("</svg>"))
    return ranked.join(parts, "motif_id", "left").join(F.broadcast(n)).select("motif_id", svg.alias("svg"))


def write_drawings(report: DataFrame, counts: DataFrame, overlaps: DataFrame, folder: str) -> None:
    """``<label>.svg``, ``<label>_reverse.svg`` and ``<label>_overlap.svg`` of each motif of ``report(motif_id, label, rank)``, read a row at a time."""
    os.makedirs(folder, exist_ok=True)
    names = report.select("motif_id", "label")
    stacks = letters(counts)
    for ending, drawn in (("", logos(stacks)), ("_reverse", logos(turned(stacks))), ("_overlap", bar_charts(report.select("motif_id", "rank"), overlaps))):
        for r in drawn.join(names, "motif_id").select("label", "svg").toLocalIterator():
            with open(os.path.join(folder, f"{r.label}{ending}.svg"), "w", encoding="utf-8") as f:
                f.write(r.svg)
