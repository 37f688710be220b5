"""Hand-computable cases, invariants and a planted motif."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Config
from quarry.functions import strings
from quarry.operators import encode, graph, intervals, matrices, merge, patterns, ranks, refine, scan, stats
from quarry.plans import discover, queries
from quarry.sources import fasta, sinks


def seqs(spark, *strings_):
    return fasta.from_strings(spark, list(strings_))


def test_fasta(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(">one\nacgt\nACGT\n>two\nACGTNCGT\n>three\r\nTTTTCCCC\r\n>short\nACG\n>four\nGGGGAAAA\n")
    got = fasta.read_fasta(spark, str(p)).orderBy("seq_id").collect()
    assert [(r.header, r.seq) for r in got] == [("one", "ACGTACGT"), ("three", "TTTTCCCC"), ("four", "GGGGAAAA")]
    assert fasta.read_fasta(spark, str(p), max_entries=1).count() == 1
    assert fasta.read_fasta(spark, str(p), max_entries=None).count() == 3
    e = tmp_path / "empty.fa"
    e.write_text("")
    assert fasta.read_fasta(spark, str(e)).count() == 0


def test_labelled_fasta(spark, tmp_path):
    p = tmp_path / "r.fa"
    p.write_text(">1.5\nacgt\nignored\n>bad\nAAAA\n>2\nCCCC\n")
    assert sorted((r.seq, r.label) for r in fasta.read_regression(spark, str(p)).collect()) == [("ACGT", 1.5), ("CCCC", 2.0)]
    c = tmp_path / "c.fa"
    c.write_text(">7\nAAAA\n>3\nCCCC\n")
    assert sorted((r.seq, r.label, r.onehot) for r in fasta.read_classification(spark, str(c)).collect()) == [("AAAA", 7, [0, 1]), ("CCCC", 3, [1, 0])]


def test_strands(spark):
    s = seqs(spark, "AACG")
    rc = s.select(encode.reverse_complement(F.col("seq")).alias("s")).first().s
    assert rc == "CGTT"
    assert s.select(encode.onehot(F.col("seq")).alias("x")).first().x == [1, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0]


def test_shuffles_keep_counts(spark):
    rng = random.Random(3)
    own = ["".join(rng.choice("ACGT") for _ in range(50)) for _ in range(40)] + ["A" * 50, "ACACAC"]
    s = seqs(spark, *own)
    real = {r.seq_id: r.seq for r in s.collect()}
    for r in encode.shuffled(s).collect():
        assert sorted(r.seq) == sorted(real[r.seq_id])
    pairs = lambda x: collections.Counter(zip(x, x[1:], strict=False))
    moved = 0
    for r in encode.dinucleotide_shuffled(s).collect():
        assert pairs(r.seq) == pairs(real[r.seq_id])
        moved += r.seq != real[r.seq_id]
    assert moved > 35
    again = {r.seq_id: r.seq for r in encode.dinucleotide_shuffled(s.repartition(3)).collect()}
    assert again == {r.seq_id: r.seq for r in encode.dinucleotide_shuffled(s).collect()}


def test_split_sizes(spark):
    for n in (0, 9, 10, 100):
        got = ranks.split(spark.range(n).withColumnRenamed("id", "seq_id"), "seq_id").groupBy("split").count().collect()
        assert {r.split: r["count"] for r in got}.get("test", 0) == n // 10


def test_triplets(spark):
    code = spark.createDataFrame([(1, 1, 2, 5.0), (1, 4, 5, 6.0), (1, 9, 7, 7.0)], "seq long, position int, fil int, mag double").withColumn("tie", F.lit(0))
    r = patterns.triplets(code).collect()
    assert [(x.f1, x.f2, x.f3, x.d12, x.d13, x.len, x.pos, x.min_mag) for x in r] == [(2, 5, 7, 3, 8, 20, 1, 5.0)]
    assert patterns.quantiles(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "mag double"), [0.35])[0] == pytest.approx(1.7)
    with pytest.raises(ValueError):
        patterns.enriched(patterns.supports(patterns.triplets(code)), trigger=3, keep=5)


def test_enriched_collapse_equals_loop(spark):
    rng = random.Random(5)
    for _ in range(4):
        table = [(i, 0, 0, 0, 0, 0, rng.randint(1, 40)) for i in range(60)]
        s = spark.createDataFrame(table, "f1 int, f2 int, f3 int, d12 int, d13 int, len int, support long")
        got = {r.f1 for r in patterns.enriched(s, trigger=8, keep=6).collect()}
        want = None
        for mark in range(200, 9, -5):
            own = [t for t in table if t[-1] > mark]
            if len(own) > 8:
                want = {t[0] for t in sorted(own, key=lambda t: (-t[-1], t[0]))[:6]}
                break
        assert got == (want if want is not None else {t[0] for t in table if t[-1] > 10})


def test_matrix_and_information(spark):
    words = spark.createDataFrame([(1, "AC"), (1, "AC"), (1, "AG"), (1, "CG")], "motif_id long, word string")
    c = matrices.count_matrix(words)
    got = {(r.offset, r.base): r.cnt for r in c.collect()}
    assert got[1, "A"] == 3 and got[1, "C"] == 1 and got[1, "G"] == 0 and got[2, "G"] == 2 and len(got) == 8
    f = {(r.offset, r.base): r.freq for r in matrices.frequency_matrix(c).collect()}
    assert f[1, "A"] == pytest.approx(3.01 / 4.04)
    assert sum(f[1, b] for b in "ACGT") == pytest.approx(1)
    ic = {r.offset: r.ic for r in matrices.information(c).collect()}
    assert 1.1 < ic[1] < 1.2 and ic[2] == pytest.approx(1, abs=0.01)


def hits(spark, rows):
    return spark.createDataFrame(rows, "motif_id long, seq_id long, pos int, comp boolean, len int")


def test_intervals(spark):
    h = hits(spark, [(1, 1, p, False, 4) for p in (1, 3, 10)] + [(2, 1, p, False, 4) for p in (1, 5)])
    u = intervals.union(h)
    assert sorted((r.motif_id, r.start, r.end) for r in u.collect()) == [(1, 1, 6), (1, 10, 13), (2, 1, 4), (2, 5, 8)]
    assert {r.motif_id: r.occupied for r in intervals.occupied(u).collect()} == {1: 10, 2: 8}
    j = intervals.jaccard(spark.createDataFrame([(1, 1, 1, 6), (2, 1, 4, 9)], "motif_id long, seq_id long, start int, end int")).first()
    assert j.jaccard == pytest.approx(1 / 3)


def test_components(spark):
    nodes = spark.range(1, 9).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(7, 2), (2, 3), (3, 8), (5, 4), (4, 5)], "i long, j long")
    got = {r.node: r.comp for r in graph.connected_components(nodes, edges).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 7: 2, 8: 2, 4: 4, 5: 4, 6: 6}


def test_components_of_a_long_chain(spark):
    # 1 - n - (n - 1) - ... - 3 - 2, and a node alone
    n = 150
    edges = spark.createDataFrame([(1, n), *((k, k - 1) for k in range(n, 2, -1))], "i long, j long")
    got = {r.node: r.comp for r in graph.connected_components(spark.range(1, n + 2).withColumnRenamed("id", "node"), edges).collect()}
    assert got == {k: 1 for k in range(1, n + 1)} | {n + 1: n + 1}


def test_fisher():
    assert stats.log10_right_tail(0, 0, 100) == 0
    exact = lambda a, b, t: sum(math.comb(t, x) * math.comb(t, a + b - x) for x in range(a, min(t, a + b) + 1)) / math.comb(2 * t, a + b)
    for a, b, t in [(5, 1, 20), (3, 3, 10), (20, 0, 20), (0, 4, 9), (50, 10, 300)]:
        assert stats.log10_right_tail(a, b, t) == pytest.approx(math.log10(exact(a, b, t)), abs=1e-9)
    tails = [stats.log10_right_tail(a, 5, 100) for a in range(5, 40)]
    assert tails == sorted(tails, reverse=True)


def test_touzet():
    w = np.log2(np.array([[0.97, 0.01, 0.01, 0.01], [0.01, 0.97, 0.01, 0.01], [0.4, 0.4, 0.1, 0.1]]) / 0.25)
    dist = stats.score_distribution(w)
    brute = collections.Counter()
    bins = np.floor(w / 0.1).astype(int)
    for a in range(4):
        for b in range(4):
            for c in range(4):
                brute[int(bins[0, a] + bins[1, b] + bins[2, c])] += 1 / 64
    assert dist.keys() == brute.keys() and all(abs(dist[k] - brute[k]) < 1e-12 for k in dist)
    for p in (0.5, 0.1, 0.02, 0.001):
        t = stats.threshold_for(w, p)
        below = [s for s in brute if sum(v for k, v in brute.items() if k >= s) < p]
        assert t == pytest.approx((min(below) if below else max(brute)) * 0.1)


def test_touzet_on_whole_matrices(spark):
    # ten columns, so p is that of 10 and 11 columns; all words by brute force
    rng = np.random.default_rng(9)
    freq = rng.dirichlet([0.4] * 4, 10) * 0.96 + 0.01
    w = np.log2(freq / 0.25)
    rows = [(1, o + 1, b, float(w[o, i])) for o in range(10) for i, b in enumerate("ACGT")]
    got = stats.touzet(spark.createDataFrame(rows, "motif_id long, offset int, base string, weight double")).first().alpha
    bins, total = np.floor(w / DEFAULT.granularity).astype(int), np.zeros(1, int)
    for column in bins:
        total = (total[:, None] + column).ravel()
    scores, n = np.unique(total, return_counts=True)
    tail = np.cumsum(n[::-1])[::-1] / 4**10
    assert DEFAULT.p_mid != DEFAULT.p_small and got == pytest.approx(scores[tail < DEFAULT.p_mid].min() * DEFAULT.granularity)


def test_scan_strands(spark):
    rng = random.Random(1)
    own = ["".join(rng.choice("ACGT") for _ in range(30)) for _ in range(20)]
    w = {1: np.log2(np.array([[0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.7, 0.1], [0.1, 0.7, 0.1, 0.1]]) / 0.25)}
    flip = [s[::-1].translate(str.maketrans("ACGT", "TGCA")) for s in own]
    a = {(r.seq_id, r.pos, r.comp): round(r.score, 6) for r in scan.scan(seqs(spark, *own), w).collect()}
    b = {(r.seq_id, 31 - r.pos - 2, not r.comp): round(r.score, 6) for r in scan.scan(seqs(spark, *flip), w).collect()}
    assert a == b and a


def test_non_overlap(spark):
    found = spark.createDataFrame([(1, 1, 5, False, 3.0), (1, 1, 7, False, 2.0), (2, 1, 12, True, 1.0), (2, 1, 8, False, 2.5)], "motif_id long, seq_id long, pos int, comp boolean, score double")
    kept = {(r.motif_id, r.pos) for r in scan.non_overlapping(found, {1: 4, 2: 4}).collect()}
    assert kept == {(1, 5), (2, 12)}


def test_non_overlap_wrapper(spark):
    """Both sides by brute force; motifs without a real hit left go."""
    rng = random.Random(2)
    lengths = {1: 4, 2: 7, 3: 5}

    def some(n, motifs):
        return [(rng.choice(motifs), rng.randrange(5), rng.randrange(1, 60), rng.random() < 0.5, float(rng.randrange(40))) for _ in range(n)]

    def brute(rows):
        out, taken = [], {}
        for m, q, p, c, x in sorted(rows, key=lambda r: (-r[4], r[0], r[2], r[3])):
            own = set(range(p, p + lengths[m]))
            if not own & taken.setdefault(q, set()):
                taken[q] |= own
                out.append((m, q, p, c, x))
        return sorted(out)

    schema = "motif_id long, seq_id long, pos int, comp boolean, score double"
    real, fake = list(set(some(200, [1, 2]))), list(set(some(200, [1, 2, 3])))
    a, b = scan.non_overlap_scan(spark.createDataFrame(real, schema), spark.createDataFrame(fake, schema), lengths)
    assert sorted(map(tuple, a.collect())) == brute(real)
    assert sorted(map(tuple, b.collect())) == [r for r in brute(fake) if r[0] != 3]


def test_masks_and_lengths(spark):
    c = matrices.count_matrix(spark.createDataFrame([(1, "ACG"), (2, "AC"), (3, "ACGTA")], "motif_id long, word string"))
    ids = lambda df: {r.motif_id for r in df.collect()}
    inside, others = matrices.by_length(c, 3, 4)
    assert ids(inside) == {1} and ids(others) == {2, 3}
    assert ids(matrices.kept(c, spark.createDataFrame([(1, True), (2, False)], "motif_id long, keep boolean"))) == {1}
    assert ids(matrices.without(c, spark.createDataFrame([(1,), (1,)], "motif_id long"))) == {2, 3}


def test_shuffles_of_any_k(spark):
    rng = random.Random(9)
    q = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(60)) if i > 2 else "ACG"[:i]) for i in range(30)], "seq_id long, seq string")
    own = {r.seq_id: r.seq for r in q.collect()}
    for k in (1, 2, 3, 4):
        got = {r.seq_id: r.seq for r in encode.klet_shuffled(q, k).collect()}
        cut = lambda s, k=k: sorted(s[i : i + k] for i in range(len(s) - k + 1))
        assert all(cut(got[i]) == cut(own[i]) and len(got[i]) == len(own[i]) for i in own)
        assert sum(got[i] != own[i] for i in own) > 15
        assert got == {r.seq_id: r.seq for r in encode.klet_shuffled(q.repartition(5), k).collect()}


def test_labelled_matrices(spark):
    rng = random.Random(9)
    q = spark.createDataFrame([(i, "".join(rng.choice("ACGT") for _ in range(40)), i % 3) for i in range(40)], "seq_id long, seq string, label int")
    rows = encode.labelled_matrices(q).collect()
    assert len(rows) == 80 and {(r.split, r.kind): sum((x.split, x.kind) == (r.split, r.kind) for x in rows) for r in rows} == {("train", "real"): 34, ("train", "shuffled"): 34, ("test", "real"): 6, ("test", "shuffled"): 6}
    real = {r.seq_id: r for r in rows if r.kind == "real"}
    pairs = lambda s: sorted(s[i : i + 2] for i in range(len(s) - 1))
    for r in rows:
        assert r.label == r.seq_id % 3 and r.split == real[r.seq_id].split and sorted(r.seq) == sorted(real[r.seq_id].seq)
        assert r.split == "train" or pairs(r.seq) == pairs(real[r.seq_id].seq)


def test_hits_moved_for_a_merge(spark):
    """Widening as the hit's strand sees it, and motifs taken in on the other strand, against letters."""
    seq = "ACGTTGCAAGGCTTACCGAT"
    q = spark.createDataFrame([(1, seq)], "seq_id long, seq string")
    h = hits(spark, [(1, 1, 5, False, 4), (1, 1, 12, True, 4), (1, 1, 2, False, 4), (2, 1, 9, True, 5)])
    got = {(r.pos, r.len, r.comp) for r in merge.enlarged(h.filter("motif_id = 1"), 2, 1, False, len(seq)).collect()}
    assert got == {(3, 7, False), (11, 7, True)}
    flipped = {(r.pos, r.len, r.comp) for r in merge.enlarged(h.filter("motif_id = 1"), 2, 1, True, len(seq)).collect()}
    assert flipped == {(3, 7, True), (11, 7, False)}
    into = merge.relabelled(h, {1: (1, False), 2: (1, True)})
    assert {(r.motif_id, r.pos, r.comp) for r in into.collect()} == {(1, 5, False), (1, 12, True), (1, 2, False), (1, 9, False)}
    words = {(r.pos, r.word) for r in matrices.windows(into, q).collect()}
    assert (9, seq[8:13]) in words


def test_equal_length_merge_against_pairs(spark):
    """What is merged is what greedy comparison of one pair after the other gives."""
    rng = np.random.default_rng(4)
    base = [np.eye(4)[rng.integers(0, 4, 6)] * 40 for _ in range(5)]
    mats = {}
    for i in range(30):
        c = base[i % 5] + rng.integers(0, 3, (6, 4))
        mats[i + 1] = c[::-1, ::-1] if i % 4 == 0 else c
    live, into = {m: c.copy() for m, c in mats.items()}, {m: m for m in mats}
    changed = True
    while changed:
        changed = False
        order = sorted(live, key=lambda m: (-live[m].sum(), m))
        for x, i in enumerate(order):
            for j in order[x + 1 :]:
                if i in live and j in live:
                    forward, reverse = merge.mean_ratio(live[i], live[j]), merge.mean_ratio(live[i], live[j][::-1, ::-1])
                    if max(forward, reverse) > DEFAULT.allr:
                        live[i] = live[i] + (live[j] if forward >= reverse else live[j][::-1, ::-1])
                        del live[j]
                        into = {m: i if r == j else r for m, r in into.items()}
                        changed = True
    assert {m: r for m, (r, _) in merge.merge_equal_lengths(mats).items()} == into and len(set(into.values())) < 30
    # small boxes and few proposals; tasks of the cluster
    decided = merge.equal_length_decisions(mats, DEFAULT.allr)
    assert merge.equal_length_decisions(mats, DEFAULT.allr, first=1, most=2) == decided
    assert merge.equal_length_decisions(mats, DEFAULT.allr, spark, first=2, most=4) == decided
    assert merge.equal_length_decisions({}, DEFAULT.allr, spark) == [] == merge.equal_length_decisions({1: mats[1]}, DEFAULT.allr, spark)


def test_screened_ratios_bound_and_equal_exact_ones():
    """Products of matrices give the ratios; uneven matrices are left to the exact one, and boxes hide nothing."""
    rng = np.random.default_rng(8)
    stack = np.array([rng.multinomial(50, p, 1)[0] for p in rng.dirichlet([0.3] * 4, 40 * 5)]).reshape(40, 5, 4).astype(float)
    stack[7, 2] *= 2
    own = merge.Stack(stack)
    assert not own.even[7] and own.even.sum() == 39
    every = np.arange(40)
    for sides, others in (((own.f, own.w), stack), (own.turned(every), stack[:, ::-1, ::-1])):
        got = own.screened(every, *sides, own.n, own.even)
        want = np.array([[merge.mean_ratio(o, c) for c in stack] for o in others])
        both = own.even[:, None] & own.even
        assert np.allclose(got[both], want[both]) and np.isinf(got[~both]).all()
    near = {(i, j) for i in range(40) for j in range(i + 1, 40) if 7 in (i, j) or max(merge.mean_ratio(stack[i], stack[j]), merge.mean_ratio(stack[i], stack[j][::-1, ::-1])) > 0.3}
    boxes = merge.Boxes(own, 4)
    for _, groups, *_ in boxes.parts:
        assert sorted(x for g in groups for x in g.tolist()) == list(range(40)) and max(map(len, groups)) <= 4
    assert {(i, j) for i, js, more in merge._proposed(boxes, 0, 0.3, 99) for j in js if not more} == near


def test_redundant_motifs_become_one(spark):
    """A motif whose hits are another's, three columns aside, joins it; one elsewhere stays."""
    rng = random.Random(6)
    word = "ACGTTGCAAGTTCAGACCAT"
    texts = []
    for _ in range(80):
        t = [rng.choice("ACGT") for _ in range(60)]
        t[10:30] = word
        t[40:46] = "GGGCCC"
        texts.append("".join(t))
    q = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    h = hits(spark, [(1, i, 10, False, 21) for i in range(80)] + [(2, i, 11, False, 20) for i in range(80)] + [(3, i, 41, False, 6) for i in range(80)])
    left = merge.remove_redundancy(h, q, 60)
    assert {r.motif_id for r in left.collect()} == {2, 3}
    assert {(r.pos, r.len) for r in left.filter("motif_id = 2").collect()} == {(11, 20)}


def test_fallback_takes_the_whole_base_set(spark):
    """No level enriches anything: every base pattern is mined, however many there are."""
    from dataclasses import replace

    from quarry.plans import discover as plan

    rows = [(s, 4 * k + 1, k, 1.0 + (k + s) % 3, None) for s in range(60) for k in range(6)]
    code = spark.createDataFrame(rows, "seq long, position int, fil int, mag double, tie string")
    config = replace(DEFAULT, max_keep=3, max_trigger=3, support_from=10**6, support_to=10**6)
    low = patterns.quantiles(code, [config.base_quantile])[0]
    want = patterns.base_patterns(patterns.triplets(code, config.height), low).count()
    assert want > 3
    import unittest.mock as mock

    none = patterns.merged_levels(code, config.levels, config.base_quantile, config.height, trigger=3, keep=3).limit(0)
    with mock.patch.object(patterns, "merged_levels", lambda *a, **k: none):
        assert plan.mined(code, config).select("motif_id").distinct().count() == want
        with mock.patch.object(plan, "MOST_PATTERNS", 2), pytest.raises(ValueError, match="more than 2 patterns"):
            plan.mined(code, config)


def test_shown_p(spark):
    values = [0.0, 0.5, 0.0123456, 0.99999, 2.34567e-9, 9.999e-5, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    got = [r.s for r in df.select(strings.shown_p(F.col("p"), F.lit(True)).alias("s")).collect()]
    assert got == ["0.0", "0.5", "0.0123", "1", "2.34e-9", "9.99e-5", "1"]
    assert df.select(strings.shown_p(F.col("p"), F.lit(False)).alias("s")).first().s == '<p style="color:grey">0.0</p>'


def test_tail_of_many_terms():
    """Summed block by block, against all terms at once; a tail of a billion background places is cut where it adds nothing."""
    from math import exp, lgamma, log

    def all_terms(a, b, total):
        k = a + b
        logs = [2 * lgamma(total + 1) - lgamma(x + 1) - lgamma(total - x + 1) - lgamma(k - x + 1) - lgamma(total - k + x + 1) - lgamma(2 * total + 1) + lgamma(k + 1) + lgamma(2 * total - k + 1) for x in range(a, min(k, total) + 1)]
        top = max(logs)
        return min(0.0, (top + log(sum(exp(x - top) for x in logs))) / log(10))

    for a, b, total in [(30_000, 29_000, 100_000), (100, 40_000, 100_000), (25_000, 24_900, 60_000), (5, 3, 20), (20, 20, 20)]:
        assert abs(stats.log10_right_tail(a, b, total) - all_terms(a, b, total)) < 1e-4
    import time

    began = time.perf_counter()
    assert stats.log10_right_tail(600_000_000, 500_000_000, 10**10) < -10**6
    assert time.perf_counter() - began < 5


def test_tail_probability_is_the_distribution_s():
    rng = np.random.default_rng(3)
    w = np.round(rng.normal(size=(5, 4)), 1)
    words = np.array([sum(np.floor(w[i, c] / 0.1) for i, c in enumerate(x)) for x in np.ndindex(4, 4, 4, 4, 4)])
    for score in (-1.0, 0.0, 2.5):
        assert abs(stats.tail_probability(w, score, 0.1) - (words * 0.1 >= score).mean()) < 1e-9


def test_classes_have_a_bound(spark, tmp_path):
    p = tmp_path / "c.fa"
    p.write_text(">7\nAAAA\n>3\nCCCC\n>4\nGGGG\n")
    with pytest.raises(ValueError, match="more than 2 labels"):
        fasta.read_classification(spark, str(p), most=2)


def test_merge_and_trim(spark):
    c = np.array([[20, 0, 0, 0], [0, 20, 0, 0], [0, 0, 20, 0], [20, 0, 0, 0]], float)
    into = merge.merge_equal_lengths({1: c, 2: c * 0.5, 3: c[::-1, ::-1], 4: c[:, ::-1][[1, 0, 3, 2]]})
    assert into[2][0] == into[1][0] == into[3][0] and into[3][1] != into[1][1]
    assert merge.sub_alignment(c[1:3], c) == (1, False)
    ic = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate([0.1, 1.5, 0.2, 1.2, 0.3])], "motif_id long, offset int, ic double")
    s = refine.span(ic, width=3).first()
    assert (s.start, s.end, s.keep) == (2, 4, True)
    h = hits(spark, [(1, 1, 10, False, 5), (1, 1, 20, True, 5)])
    assert sorted((r.pos, r.len) for r in refine.trim_hits(h, refine.span(ic, width=3)).collect()) == [(11, 3), (21, 3)]


def test_expansion_and_shrinkage_have_no_bound(spark):
    rng = random.Random(3)
    core = "".join(rng.choice("ACGT") for _ in range(40))
    texts = ["".join(rng.choice("ACGT") for _ in range(5)) + core + "".join(rng.choice("ACGT") for _ in range(15)) for _ in range(200)]
    flip = [t[::-1].translate(str.maketrans("ACGT", "TGCA")) for t in texts[:100]] + texts[100:]
    q = spark.createDataFrame(list(enumerate(flip)), "seq_id long, seq string")
    # core is columns 6 to 45; the hits see 8 of them, seen on either strand
    h = hits(spark, [(1, i, 30 if i < 100 else 24, i < 100, 8) for i in range(200)])
    out = refine.expansion(h, q)
    assert [tuple(r) for r in out.collect()] == [(1, 18, 14)]
    # 15 uninformative columns behind the core
    w = hits(spark, [(2, i, 1 if i < 100 else 6, i < 100, 55) for i in range(200)])
    got = refine.shrinkage(w, q, spark.createDataFrame([(2, 0, 0)], "motif_id long, left int, right int"))
    assert [tuple(r) for r in got.collect()] == [(2, 0, 15)]
    edge = hits(spark, [(3, i, 1, False, 60) for i in range(100, 200)])
    assert [tuple(r) for r in refine.expansion(edge, q).collect()] == [(3, 0, 0)]


def test_wide_motifs_have_a_threshold(spark):
    rng = random.Random(4)
    # about four of five letters of the passage are kept: 24 informative columns in one segment
    core = "".join(rng.choice("ACGT") for _ in range(24))
    own = []
    for i in range(300):
        s = [rng.choice("ACGT") for _ in range(60)]
        if i % 2 == 0:
            s[20:44] = [c if rng.random() < 0.75 else rng.choice("ACGT") for c in core]
        own.append((i, "".join(s)))
    q = spark.createDataFrame(own, "seq_id long, seq string")
    train, test = q.filter("seq_id < 200"), q.filter("seq_id >= 200")
    # motif 2 is noise without a segment
    words = [(1, s[20:44]) for i, s in own[:200] if i % 2 == 0] + [(2, "".join(rng.choice("ACGT") for _ in range(12))) for _ in range(400)]
    counted = matrices.count_matrix(spark.createDataFrame(words, "motif_id long, word string"))
    weights = matrices.weight_matrix(matrices.frequency_matrix(counted))
    segments = matrices.high_segments(matrices.information(counted))
    assert [(r.motif_id, r.end - r.start + 1 > 15) for r in segments.collect()] == [(1, True)]
    mats = scan.gathered(weights)
    marks = discover.score_marks(weights, segments, mats, train, encode.dinucleotide_shuffled(train), 2 * 200 * 60)
    assert marks[1] > 3
    rows = discover.report(counted, train, test, 60).collect()
    assert [r.motif_id for r in rows] == [1] and rows[0].p_value < 1e-10
    # about one hit in each sequence that has the passage
    assert 130 <= rows[0].counts <= 170


def test_greedy_align_trims(spark):
    import inspect

    rng = random.Random(14)
    core = "TGACGTCATCAGGC"
    own, rows = [], []
    for i in range(120):
        s = [rng.choice("ACGT") for _ in range(60)]
        s[20:34] = core
        own.append((i, "".join(s)))
        # three uninformative columns on each side
        rows.append((1, i, 18, False, 20))
    q = spark.createDataFrame(own, "seq_id long, seq string")
    got = discover.greedy_align(hits(spark, rows), q, 60, rounds=0, last=1)
    assert {(r.pos, r.len) for r in got.filter("not comp").collect()} >= {(21, 14)} and {r.len for r in got.collect()} == {14}
    assert inspect.signature(discover.greedy_align).parameters["rounds"].default == 13


def test_strings(spark):
    f = spark.createDataFrame([(1, 1, "A", 0.9), (1, 1, "C", 0.1), (1, 2, "A", 0.4), (1, 2, "C", 0.4)], "motif_id long, offset int, base string, freq double")
    assert strings.consensus(f).first().consensus == "A."
    s = spark.createDataFrame([("ACG",), ("AG",)], "n string")
    assert strings.similarity(s, "n", "n").first().sim == 2
    d = spark.createDataFrame([("--ACG-A-TT-ACGT--.",)], "d string").select(strings.cleaned(F.col("d")).alias("d")).first().d
    assert d == "ACGT"


def test_planted_motif(spark, tmp_path):
    rng = random.Random(11)
    motif = "TGACGTCATC"
    out = []
    for i in range(400):
        s = [rng.choice("ACGT") for _ in range(60)]
        if i % 2 == 0:
            at = rng.randint(0, 50)
            s[at : at + 10] = motif
        out.append("".join(s))
    p = tmp_path / "planted.fa"
    p.write_text("".join(f">s{i}\n{s}\n" for i, s in enumerate(out)))
    small = Config(height=8, levels=(0.05, 0.5))
    found = discover.discover_motifs(spark, str(p), str(tmp_path / "out"), config=small, most_motifs=12)
    report = found.report.orderBy("rank").collect()
    assert report and any("GACGTCA" in r.consensus or "TGACGTC" in r.consensus for r in report)
    assert min(r.p_value for r in report) < 1e-3
    assert (tmp_path / "out" / "summary.html").exists() and list((tmp_path / "out" / "matrices" / "meme").glob("motif_id=*"))


def test_dominant_passage_leaves_rarer_motifs(spark):
    # shifted versions of the passage alone are more patterns than any small number of places
    rng = random.Random(12)
    out = []
    for i in range(300):
        s = [rng.choice("ACGT") for _ in range(60)]
        if i % 2 == 0:
            at = rng.randint(0, 42)
            s[at : at + 18] = "ACCATGGTTCAGACTTGC"
        elif i % 4 == 1:
            at = rng.randint(0, 48)
            s[at : at + 12] = "TGACGTCATCAG"
        out.append("".join(s))
    found = discover.discover(seqs(spark, *out), 60, config=Config(height=8, levels=(0.05, 0.5)))
    text = [r.consensus for r in found.report.collect()]
    assert any("GACGTCA" in t for t in text) or any("TGACGTC" in t for t in text)


def test_merges_in_bulk_decide_one_by_one(spark):
    rng = np.random.default_rng(5)
    base = [rng.dirichlet([0.3] * 4, n) for n in (6, 6, 9)]
    own = {m: rng.poisson(base[m % 3] * rng.integers(5, 200)).astype(float)[:: 1 - 2 * (m % 2), :: 1 - 2 * (m % 2)] for m in range(1, 25)}
    uneven = own[5].copy()
    uneven[1] *= 2
    own[5] = uneven
    longer = merge.Longer(own)
    order = longer.order
    assert order == sorted(own, key=lambda m: (len(own[m]), -own[m].sum(), m))
    want = {(x, y, *f) for x, i in enumerate(order) for y in range(x + 1, len(order)) if (f := merge.sub_alignment(own[i], own[order[y]], 0.5, 80))}
    assert {(r.x, r.z, r.offset, r.turned) for r in merge.sub_alignments(own, spark, 0.5).collect()} == want and len(want) > 20
    some = merge.sub_alignments(longer, spark, 0.5, first=2).collect()
    assert {(r.x, r.more) for r in some} == {(x, sum(w[0] == x for w in want) > 2) for x in {w[0] for w in want}} and max(sum(r.x == s.x for r in some) for s in some) == 2
    assert merge.sub_alignments({}, spark).count() == 0 == merge.sub_alignments({1: own[1]}, spark).count()
    # a grown matrix is found with its new counts, among few places as among all
    own[order[-1]] = own[order[-1]] + own[order[-2]]
    longer.update(len(order) - 1, own[order[-1]])
    for x, i in enumerate(order[:-1]):
        f = merge.sub_alignment(own[i], own[order[-1]], 0.5, 80)
        for among in (None, np.array([len(order) - 1])):
            (places,) = longer.near(x, x + 1, 0.5, 80, among)
            assert [r[1:] for r in longer.alignments(own[i], places, 0.5) if r[0] == len(order) - 1] == ([f] if f else [])
    passage = "TGACGTCATCAGGTCA"
    texts = []
    for _ in range(40):
        s = [rng.choice(list("ACGT")) for _ in range(60)]
        s[20:36] = passage
        texts.append("".join(s))
    h = hits(spark, [(m, q + 1, 21 + o, m == 3, n) for q in range(40) for m, (o, n) in enumerate([(0, 8), (2, 9), (1, 10), (0, 16)], 1)])
    q = spark.createDataFrame(list(enumerate(texts, 1)), "seq_id long, seq string")
    a, b = (merge.alignment_merge(h, q, 60, ahead=n).collect() for n in (250, 1))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and {(r.motif_id, r.pos, r.len) for r in a} >= {(4, 21, 16)} and len({r.motif_id for r in a}) < 4


def test_alignment_decisions_against_letters(spark):
    """Each decision and all hits, against a plain loop that cuts the widened hits' letters anew for each pair."""
    rng = random.Random(3)
    passage = "TGACGTCATCAGGTCAGGCATTCC"
    texts = []
    for _ in range(30):
        s = [rng.choice("ACGT") for _ in range(60)]
        s[18:42] = passage
        texts.append("".join(s))
    # pieces of the passage, some on the other strand, one whose widened hits leave the sequence, and one that is elsewhere
    pieces = [(0, 8, False), (3, 8, True), (2, 12, False), (6, 9, False), (1, 14, True), (0, 24, False), (9, 10, True)]
    own = [(m, q, 19 + o, c, n) for q in range(30) for m, (o, n, c) in enumerate(pieces, 1)] + [(8, q, 1, False, 8) for q in range(30)]
    seq = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    turn = lambda w: w[::-1].translate(str.maketrans("ACGT", "TGCA"))

    def matrix(of):
        words = [turn(texts[q][p - 1 : p - 1 + n]) if c else texts[q][p - 1 : p - 1 + n] for _, q, p, c, n in of]
        return np.array([[sum(w[o] == b for w in words) for b in "ACGT"] for o in range(of[0][4])], float) if of else None

    live = {m: [r for r in own if r[0] == m] for m in range(1, 9)}
    mats = {m: matrix(live[m]) for m in live}
    order, want = sorted(mats, key=lambda m: (len(mats[m]), -mats[m].sum(), m)), []
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            found = merge.sub_alignment(mats[i], mats[j])
            if not found:
                continue
            rest = len(mats[j]) - len(mats[i]) - found[0]
            front, back = (rest, found[0]) if found[1] else (found[0], rest)
            wide = [(j, q, p - (back if c else front), c != found[1], n + front + back) for _, q, p, c, n in live[i]]
            wide = [r for r in wide if r[2] >= 1 and r[2] + r[4] - 1 <= 60]
            if wide and (ratio := merge.mean_ratio(matrix(wide), mats[j])) > DEFAULT.allr:
                want.append((j, i, front, back, found[1], round(ratio, 9)))
                live[j] += wide
                mats[j] = mats[j] + matrix(wide)
                del live[i]
                break
    for options in ({}, {"ahead": 1}, {"first": 1}, {"ahead": 2, "first": 1}):
        left, decided = merge.alignment_decisions(hits(spark, own), seq, 60, **options)
        assert [(*d[:5], round(d[5], 9)) for d in decided] == want and len(want) >= 4
        assert sorted(map(tuple, left.select("motif_id", "seq_id", "pos", "comp", "len").collect())) == sorted(r for m in live for r in ((m, *x[1:]) for x in live[m]))


def test_learned_encoder_finds_planted_word(spark):
    from quarry.operators import learned

    rng = random.Random(11)
    out = []
    for i in range(400):
        s = [rng.choice("ACGT") for _ in range(60)]
        if i % 2 == 0:
            at = rng.randint(0, 52)
            s[at : at + 8] = "TGACGTCA"
        out.append("".join(s))
    q = seqs(spark, *out)
    e = learned.train(q, epochs=10)
    assert e.history[-1] < e.history[0]
    assert any("".join("ACGT"[j] for j in f.argmax(1)) in "GTGACGTCAC" or "GACGTC" in "".join("ACGT"[j] for j in f.argmax(1)) for f in e.filters)
    assert np.allclose(e.filters.sum(-1), 1)
    code = e.encode(q)
    per = code.groupBy("seq").count().agg(F.max("count").alias("m"), F.count("*").alias("n")).first()
    assert per.m <= DEFAULT.sparsity and per.n == 400
    again = e.encode(q.repartition(3))
    assert sorted(map(tuple, code.collect())) == sorted(map(tuple, again.collect()))


def test_learned_encoder_takes_all_sequences(spark):
    from quarry.operators import learned

    rng = random.Random(6)
    out = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(900)]
    q = seqs(spark, *out)

    def step(f):
        return np.full((2, 2, 4), 0.25), float(len(f))

    blocks = q.select("seq_id", "seq", F.pmod(F.xxhash64("seq_id"), F.lit(9)).alias("block"))
    logs, spent = learned._epoch(blocks, step)
    assert spent == 900 and np.allclose(logs, 900 * np.log(0.25))
    a, b = (learned.train(x, epochs=2, block=100) for x in (q, q.repartition(5)))
    assert np.allclose(a.filters, b.filters) and np.allclose(a.filters.sum(-1), 1) and a.history[-1] < a.history[0]
    # a change of any one sequence changes the filters
    other = q.withColumn("seq", F.when(F.col("seq_id") == q.agg(F.max("seq_id")).first()[0], "A" * 40).otherwise(F.col("seq")))
    assert not np.allclose(a.filters, learned.train(other, epochs=2, block=100).filters, atol=1e-12, rtol=0)


def test_epochs_and_sinks(spark):
    assert [DEFAULT.epochs(n) for n in (10, 5_000, 50_000, 500_000)] == [25, 10, 5, 3]
    c = matrices.count_matrix(spark.createDataFrame([(1, "AC")] * 4, "motif_id long, word string"))
    lines = [r.line for r in sinks.transfac_lines(c).orderBy("line_no").collect()]
    assert lines[5:7] == ["01\t3\t0\t0\t0", "02\t0\t3\t0\t0"] or lines[5].startswith("01\t")
    back = [r.line for r in sinks.transfac_lines(c, reverse=True).orderBy("line_no").collect()]
    assert back[5].split("\t")[3] == lines[6].split("\t")[2]


def test_stream_scan(spark, tmp_path):
    from quarry.streaming.scan import scan_stream

    src = tmp_path / "in"
    spark.createDataFrame([(1, "ACGACG"), (2, "TTTTTT")], "seq_id long, seq string").write.parquet(str(src))
    stream = spark.readStream.schema("seq_id long, seq string").parquet(str(src))
    w = {1: np.log2(np.array([[0.97, 0.01, 0.01, 0.01], [0.01, 0.97, 0.01, 0.01]]) / 0.25)}
    q = scan_stream(stream, w, {1: 3.0}).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.seq_id, r.pos) for r in spark.table("hits").filter("not comp").collect()) == [(1, 1), (1, 4)]


def test_queries_registered():
    assert len(queries.QUERIES) >= 50


def test_best_offset_against_plain_slides(spark):
    """Ragged lengths over several blocks, against one pair after the other; no motif and one motif have no pair."""
    rng = np.random.default_rng(9)
    own = {m: rng.poisson(rng.dirichlet([0.4] * 4, int(rng.integers(3, 9))) * 40) + 1.0 for m in range(1, 41)}
    rows = [(m, o + 1, b, int(v)) for m, c in own.items() for o, col in enumerate(c) for b, v in zip("ACGT", col, strict=True)]
    schema = "motif_id long, offset int, base string, cnt long"

    def slid(a, b, shift):
        lo, hi = max(0, shift), min(len(a), len(b) + shift)
        fa, fb = ((x + 0.01) / (x.sum(1, keepdims=True) + 0.04) for x in (a, b))
        na, nb = a[0].sum(), b[0].sum()
        x, y = fa[lo:hi], fb[lo - shift : hi - shift]
        return round(float(((na * x * np.log2(y / 0.25) + nb * y * np.log2(x / 0.25)).sum(1) / (na + nb)).sum()), 9)

    want = {}
    for i, a in own.items():
        for j, b in own.items():
            if i < j:
                able = [s for s in range(1 - len(b), len(a)) if min(len(a), len(b) + s) - max(0, s) >= min(len(a), len(b)) - 4]
                want[i, j] = max((slid(a, b, s), -s) for s in able)
    got = {(r.i, r.j): (r.allr, -r["shift"]) for r in merge.best_offset(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == want.keys() and all(abs(got[p][0] - want[p][0]) < 2e-9 and got[p][1] == want[p][1] for p in want)
    assert merge.best_offset(spark.createDataFrame([], schema)).count() == 0 == merge.best_offset(spark.createDataFrame(rows[:12], schema).filter("motif_id = 1")).count()


def test_triples_of_too_many_events_are_an_error(spark):
    few = spark.range(4).selectExpr("1L AS seq", "cast(id AS int) AS position", "0 AS fil", "1.0D AS mag", "id AS tie")
    assert patterns.triplets(few).count() == 4
    many = spark.range(patterns.MOST_EVENTS + 1).selectExpr("1L AS seq", "cast(id AS int) AS position", "0 AS fil", "1.0D AS mag", "id AS tie")
    with pytest.raises(Exception, match="513 events of one sequence"):
        patterns.triplets(many).count()
