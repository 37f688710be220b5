"""Report files: TRANSFAC and MEME matrices as rows of text, an HTML summary, and the folders they go to."""

from __future__ import annotations

import html
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.strings import shown_p
from ..operators.matrices import frequency_matrix

FOLDERS = ("matrices", "matrices_no_overlap", "logos", "logos_no_overlap")


def folders(target: str) -> list[str]:
    """Makes the folders of a report."""
    out = [os.path.join(target, f) for f in FOLDERS]
    for f in out:
        os.makedirs(f, exist_ok=True)
    return out


def transfac_lines(counts: DataFrame, reverse: bool = False, thousandths: bool = False) -> DataFrame:
    """(motif_id, line_no, line): a TRANSFAC matrix of each motif, frequencies times sites, rounded down.

    With ``thousandths`` cells are the shares of the counts themselves, times 1,000: the form for debugging.
    """
    f = frequency_matrix(counts, 0.0) if thousandths else frequency_matrix(counts)
    sites = counts.filter("offset = 1").groupBy("motif_id").agg(F.sum("cnt").alias("sites"), F.lit(1).alias("one"))
    width = counts.groupBy("motif_id").agg(F.max("offset").alias("len"))
    f = f.join(F.broadcast(sites), "motif_id").join(F.broadcast(width), "motif_id")
    if reverse:
        f = f.withColumns({"offset": F.col("len") + 1 - F.col("offset"), "base": F.translate("base", "ACGT", "TGCA")})
    cell = F.floor(F.col("freq") * (F.lit(1000) if thousandths else F.col("sites"))).cast("long")
    rows = f.groupBy("motif_id", "offset").agg(*[F.max(F.when(F.col("base") == b, cell)).alias(b) for b in "ACGT"])
    body = rows.select("motif_id", (F.col("offset") + 5).alias("line_no"), F.concat_ws("\t", F.lpad(F.col("offset").cast("string"), 2, "0"), *[F.col(b).cast("string") for b in "ACGT"]).alias("line"))
    head = [(1, "ID\t"), (2, "XX\t"), (3, "BF\t"), (4, "XX\t"), (5, "P0\tA\tC\tG\tT")]
    top = width.select("motif_id", F.explode(F.array(*[F.struct(F.lit(n).alias("line_no"), F.lit(s).alias("line")) for n, s in head])).alias("x")).select("motif_id", "x.line_no", "x.line")
    end = width.select("motif_id", (F.col("len") + 6).alias("line_no"), F.lit("XX\t").alias("line"))
    return top.unionByName(body).unionByName(end)


def meme_lines(counts: DataFrame, name: str = "unspecified") -> DataFrame:
    """(motif_id, line_no, line): a MEME letter-probability matrix of each motif."""
    f = frequency_matrix(counts)
    info = counts.groupBy("motif_id").agg(F.max("offset").alias("len"), F.sum(F.when(F.col("offset") == 1, F.col("cnt"))).cast("long").alias("sites"))
    rows = f.groupBy("motif_id", "offset").agg(*[F.max(F.when(F.col("base") == b, F.col("freq"))).alias(b) for b in "ACGT"])
    body = rows.select("motif_id", (F.col("offset") + 11).alias("line_no"), F.concat(F.lit(" "), F.concat_ws(" ", *[F.format_number(b, 6) for b in "ACGT"])).alias("line"))
    fixed = ["MEME version 4", "", "ALPHABET= ACGT", "", "strands: + -", "", "Background letter frequencies", "A 0.25 C 0.25 G 0.25 T 0.25", ""]
    lines = [F.struct(F.lit(i + 1).alias("line_no"), F.lit(s).alias("line")) for i, s in enumerate(fixed)]
    lines.append(F.struct(F.lit(10).alias("line_no"), F.concat(F.lit("MOTIF "), F.col("motif_id").cast("string"), F.lit(f" {name}")).alias("line")))
    lines.append(F.struct(F.lit(11).alias("line_no"), F.concat(F.lit("letter-probability matrix: alength= 4 w= "), F.col("len").cast("string"), F.lit(" nsites= "), F.col("sites").cast("string"), F.lit(" E= 0")).alias("line")))
    top = info.select("motif_id", F.explode(F.array(*lines)).alias("x")).select("motif_id", "x.line_no", "x.line")
    return top.unionByName(body)


def write_matrices(counts: DataFrame, target: str) -> None:
    """A folder of text for each motif and format; a motif's lines are one small group."""
    for kind, lines in (("transfac", transfac_lines(counts)), ("debug", transfac_lines(counts, thousandths=True)), ("transfac_reverse", transfac_lines(counts, reverse=True)), ("meme", meme_lines(counts))):
        lines.repartition("motif_id").sortWithinPartitions("motif_id", "line_no").select("motif_id", "line").write.partitionBy("motif_id").mode("overwrite").text(f"{target}/{kind}")


def write_html(report: DataFrame, path: str, sequences: int, overlapping: bool = True, alpha: float = 1e-5, drawings: str | None = None) -> None:
    """One table of ``report(label, p_value, consensus, counts)``, a row a motif; ``overlapping`` says how its hits were counted, and
    ``drawings`` where, from the page, the motifs' drawings lie."""
    shown = report.withColumn("shown", shown_p(F.col("p_value"), F.col("p_value") < alpha))
    drawn = lambda label: "" if drawings is None else "".join(f"<td><img src='{drawings}/{label}{x}.svg' alt='{label}{x}'></td>" for x in ("", "_reverse", "_overlap"))
    rows = "\n".join(f"<tr><td>{html.escape(str(r.label))}</td><td>{r.shown}</td><td><code>{html.escape(r.consensus)}</code></td><td>{r.counts}</td>{drawn(html.escape(str(r.label)))}</tr>" for r in shown.orderBy("rank").collect())
    kind = "" if overlapping else " (without overlaps)"
    page = f"<!doctype html><meta charset=utf-8><title>Patterns{kind}</title><p>Sequences: {sequences}</p><table><tr><th>Label</th><th>p</th><th>Consensus</th><th>Count</th>{'' if drawings is None else '<th>Logo</th><th>Other strand</th><th>Overlaps</th>'}</tr>\n{rows}\n</table>\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
