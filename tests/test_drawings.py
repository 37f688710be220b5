"""Drawings of a report, and the run without refinement."""

import os
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quarry.config import DEFAULT
from quarry.operators import matrices
from quarry.plans import discover as plan
from quarry.sources import drawings

NS = "{http://www.w3.org/2000/svg}"


def counted(spark, *words):
    return matrices.count_matrix(spark.createDataFrame([(m, w) for m, ws in enumerate(words, 1) for w in ws], "motif_id long, word string"))


def test_stacks_hold_the_information(spark):
    counts = counted(spark, ["ACGT", "ACGA", "ACTT", "AGTT"], ["AAAA", "CCCC", "GGGG", "TTTT"])
    rows = drawings.letters(counts).collect()
    ic = {(r.motif_id, r.offset): r.ic for r in matrices.information(counts, DEFAULT.ps_ic).collect()}
    for key, total in ic.items():
        own = sorted((r for r in rows if (r.motif_id, r.offset) == key), key=lambda r: r.bottom)
        assert len(own) == 4 and sum(r.height for r in own) == pytest.approx(max(total, 0), abs=1e-9)
        at = 0.0
        for r in own:
            assert r.bottom == pytest.approx(at, abs=1e-9)
            at += r.height
        assert [r.height for r in own] == sorted(r.height for r in own)
    top = max((r for r in rows if (r.motif_id, r.offset) == (1, 1)), key=lambda r: r.bottom)
    assert top.base == "A"
    svg = {r.motif_id: ET.fromstring(r.svg) for r in drawings.logos(drawings.letters(counts)).collect()}
    assert svg[1].get("width") == str(4 * drawings.COLUMN) and "A" in {t.text for t in svg[1].iter(f"{NS}text")} and not list(svg[2].iter(f"{NS}text"))
    back = {(r.offset, r.base): r.height for r in drawings.turned(drawings.letters(counts)).filter("motif_id = 1").collect()}
    assert back[4, "T"] == pytest.approx(next(r.height for r in rows if (r.motif_id, r.offset, r.base) == (1, 1, "A")))


def test_bars_skip_their_own_place(spark):
    ranked = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "motif_id long, rank int")
    overlaps = spark.createDataFrame([(10, 20, 0.5), (20, 30, 0.25)], "i long, j long, jaccard double")
    assert sorted(map(tuple, drawings.bars(ranked, overlaps).collect())) == [(10, 20, 1, 0.5), (20, 10, 1, 0.5), (20, 30, 2, 0.25), (30, 20, 2, 0.25)]
    svg = {r.motif_id: ET.fromstring(r.svg) for r in drawings.bar_charts(ranked, overlaps.filter("i = 10")).collect()}
    assert [len(list(svg[m].iter(f"{NS}rect"))) for m in (10, 20, 30)] == [1, 1, 0]
    (bar,) = svg[10].iter(f"{NS}rect")
    assert float(bar.get("height")) == drawings.UNIT / 2


def planted(n=400, length=60, word="TGACGTCATCAGG"):
    rng, out = random.Random(5), []
    for i in range(n):
        s = [rng.choice("ACGT") for _ in range(length)]
        if i % 2:
            at = rng.randint(0, length - len(word))
            s[at : at + len(word)] = word
        out.append("".join(s))
    return out


def test_files_stand_beside_the_page(spark, tmp_path):
    path = tmp_path / "in.fa"
    path.write_text("".join(f">{i} > {i}\n{s}\n" for i, s in enumerate(planted())))
    target = str(tmp_path / "out")
    found = plan.discover_motifs(spark, str(path), target, most_motifs=12)
    labels = [r.label for r in found.report.collect()]
    assert labels
    page = open(f"{target}/summary.html", encoding="utf-8").read()
    for label in labels:
        for ending in ("", "_reverse", "_overlap"):
            name = f"logos/{label}{ending}.svg"
            assert name in page and ET.parse(f"{target}/{name}").getroot().tag == f"{NS}svg"
    again = [r.label for r in found.report_no_overlap.collect()]
    assert all(os.path.exists(f"{target}/logos_no_overlap/{x}.svg") for x in again)


def test_without_refinement_nothing_is_merged(spark, monkeypatch):
    seen = []
    mined = plan.mined
    monkeypatch.setattr(plan, "mined", lambda code, config: (seen.append(config.levels), mined(code, config))[1])
    for name in ("merged", "trimmed"):
        monkeypatch.setattr(plan, name, lambda *a: pytest.fail("refined"))
    q = spark.createDataFrame(list(enumerate(planted(300), 1)), "seq_id long, seq string")
    found = plan.discover(q, 60, refinement=False, most_motifs=20)
    assert seen == [(0.25, 0.35, 0.45, 0.5, 0.65, 0.75)]
    assert 0 < found.hits.select("motif_id").distinct().count() <= 20
    assert found.hits.filter(F.col("comp")).count() == 0  # mined hits have one strand
