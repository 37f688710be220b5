"""Exact quantiles by selection, refined thresholds, and numbers of FASTA records, each against a plain version."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import encode, patterns, ranks, stats
from quarry.sources import fasta

PS = [0.0, 0.01, 0.25, 0.35, 0.5, 0.75, 0.999, 1.0]


def codes(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "mag double").repartition(3)


@pytest.mark.parametrize("most", [4, 50, 10_000])
def test_quantiles_equal_percentile(spark, most):
    rng = random.Random(most)
    cases = {
        "distinct": [rng.random() * 100 for _ in range(900)], "ties": [rng.choice([1.5, 2.5, 7.0]) for _ in range(400)], "hot": [3.25] * 500 + [rng.gauss(0, 1) for _ in range(300)],
        "scales": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200) for _ in range(200)], "one": [7.5], "two": [1.0, 2.0], "same": [4.0] * 9, "nulls": [None, 1.0, None, 2.0, 4.0], "near": [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0)] * 5,
        "ends": [-1.7e308, 1.7e308, 0.0, 5e-324],
    }
    for name, values in cases.items():
        df = codes(spark, values)
        want = df.agg(F.percentile("mag", F.array(*[F.lit(p) for p in PS]))).first()[0]
        assert patterns.quantiles(df, PS, most=most) == want, name
    assert patterns.quantiles(codes(spark, [None]).limit(0), [0.5]) == [float("inf")]
    with pytest.raises(ValueError):
        patterns.quantiles(codes(spark, [1.0, float("nan")]), [0.5])


def test_no_aggregate_outgrows_its_bound(spark, monkeypatch):
    """With all magnitudes different, what reaches the driver is at most ``most`` rows an interval."""
    sizes, frame = [], type(spark.range(0))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (sizes.append(len(got := collect(self))), got)[1])
    df = spark.range(20_000).select(F.rand(3).alias("mag"))
    df.write.mode("overwrite").parquet(path := "/tmp/quantiles-%d.parquet" % random.getrandbits(40))
    df = spark.read.parquet(path)
    got = patterns.quantiles(df, [0.35, 0.5], most=64)
    # two ranks a quantile
    assert len(sizes) >= 2 and max(sizes) <= 64 * 4
    assert got == df.agg(F.percentile("mag", F.array(F.lit(0.35), F.lit(0.5)))).first()[0]


def scores(w):
    return np.array([sum(w[i, b] for i, b in enumerate(word)) for word in itertools.product(range(4), repeat=len(w))]) if len(w) <= 6 else sum(np.meshgrid(*w, indexing="ij")).ravel()


@pytest.mark.parametrize("width", [1, 2, 4, 7, 10])
def test_refined_thresholds_equal_full_enumeration(width):
    rng = np.random.default_rng(width)
    for trial in range(8):
        w = np.log2(rng.dirichlet(np.ones(4) * 0.5, width) + 0.01) + 2
        if trial % 3 == 1:
            w = np.round(w, 3)  # scores on a grid, with ties
        x = np.sort(np.round(scores(w), 9))
        for p in (0.3, 0.01, 3e-4, 1e-4, 1e-9):
            alpha, tail = stats.refined_threshold(w, p, finest=1e-8)
            values, first = np.unique(x, return_index=True)
            tails = 1 - first / len(x)
            under = np.flatnonzero(tails < p - 1e-15)
            want = values[under[0]] if len(under) else values[-1]
            # the same words pass, and their share is the tail
            # rounded down, alpha may lie under its own word by the error, and above no other
            assert (x >= alpha - 1e-9).sum() == (x >= want).sum(), (trial, p)
            assert tail == pytest.approx((x >= want).mean(), abs=1e-12)


def test_the_distribution_stays_in_reach():
    rng = np.random.default_rng(3)
    w = np.log2(rng.dirichlet(np.ones(4), 10) + 0.01) + 2
    g = 0.01
    whole = stats.score_distribution(w, g)
    lo, hi = 8.0, 8.5
    sums, probs, above, widest = stats.reachable(w, lo, hi, g)
    assert above == pytest.approx(sum(p for s, p in whole.items() if s >= round(hi / g)))
    assert {i: pytest.approx(p) for i, p in zip(sums.tolist(), probs.tolist())} == {s: p for s, p in whole.items() if round(lo / g) <= s < round(hi / g)}
    assert widest < max(whole) - min(whole)
    assert stats.rounding_error(w, g) == pytest.approx(sum(max(v - np.floor(v / g) * g for v in row) for row in w))
    x, rounded = scores(w), scores(np.floor(w / g) * g)
    assert (x - rounded).max() == pytest.approx(stats.rounding_error(w, g)) and (x - rounded).min() >= -1e-9


def fasta_files(folder, n=700):
    rng, rows, number = random.Random(1), [], 0
    for f in ("a.fa", "b.fa", "c.fa"):
        text = "; a remark before the first record\n" if f == "b.fa" else "\n" if f == "c.fa" else ""
        number += f != "a.fa"  # what stands before the first record
        for i in range(n):
            seq = "".join(rng.choice("acgtACGT" if i % 50 else "ACGN") for _ in range(40))
            end = "\r\n" if f == "b.fa" else "\n"
            header = f"{f} {i} > b>c" if i % 7 else f">{i}"
            text += f">{header}{end}{seq[:15]}{end}{seq[15:]}{end}"
            number += 1
            rows.append((number, header, seq.upper()))
        (folder / f).write_text(text, newline="")
    return [r for r in rows if "N" not in r[2]]


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    want = fasta_files(tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    reports = []
    try:
        for size in ("128m", "20k", "2k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            q = fasta.read_fasta(spark, str(tmp_path))
            assert sorted(map(tuple, q.collect())) == want
            assert [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path), max_entries=90).orderBy("seq_id").collect()] == [(i, *r[1:]) for i, r in enumerate(want[:90], 1)]
            reports.append((sorted(map(tuple, ranks.split(q.select("seq_id", "seq"), "seq_id").collect())), sorted(map(tuple, encode.dinucleotide_shuffled(q.select("seq_id", "seq")).collect()))))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert reports[0] == reports[1] == reports[2]


def test_one_letter_has_a_likelihood(spark):
    q = spark.createDataFrame([(1, "A"), (2, "AC"), (3, "ACCA")], "seq_id long, seq string")
    got = {r.seq_id: r.loglik for r in encode.log_likelihood(q).collect()}
    assert got[1] == pytest.approx(np.log(4 / 7))
    assert all(v is not None for v in got.values())
