"""Steps whose work on large tables was measured: what they read, shuffle and make, and that their results stay what they were."""

import hashlib
import random
from collections import Counter
from dataclasses import replace
from unittest import mock

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.config import DEFAULT
from quarry.operators import encode, intervals, matrices, merge, patterns, refine, scan, syntax, tape, triples
from quarry.plans import discover, queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def once(spark, df, schema):
    """``df`` through a task that counts its rows, and the counter."""
    seen = spark.sparkContext.accumulator(0)

    def run(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    return df.mapInPandas(run, schema), seen


def test_shuffled_letters_follow_the_hash(spark):
    rows = [(5, "ACGTACGTTT"), (1 << 40, "ÄC€𝔸Gx"), (-3, "A"), (7, ""), (8, None)]
    out = encode.shuffled(spark.createDataFrame(rows, "seq_id long, seq string"), "s")
    want = {i: "".join(s[p - 1] for p in sorted(range(1, len(s) + 1), key=lambda p: hashlib.md5(f"s{i}:{p}".encode()).hexdigest())) for i, s in rows if s}
    assert {r.seq_id: r.seq for r in out.collect()} == want
    assert "MapInArrow" in plan(out)


def test_walks_of_many_sequences_are_uniform():
    """All orders of a word with its pairs' counts come equally often."""
    n = 30_000
    word = encode.letter_codes("AACACAAGAC")
    got = Counter(map(bytes, encode.euler_shuffles(np.tile(word, (n, 1)), np.arange(n), 2, 1)))
    assert len(got) == 30 and sum((v - 1000) ** 2 / 1000 for v in got.values()) < 60
    long = np.random.default_rng(1).integers(0, 4, (50, 60)).astype(np.uint8)
    for k in (1, 2, 3):
        for a, b in zip(long, encode.euler_shuffles(long, np.arange(50), k, 2), strict=True):
            assert Counter(bytes(a[i : i + k]) for i in range(61 - k)) == Counter(bytes(b[i : i + k]) for i in range(61 - k))


def test_splits_are_drawn_once(spark):
    own, seen = once(spark, spark.createDataFrame([(i, "ACGTTGCA" * 3) for i in range(40)], "seq_id long, seq string"), "seq_id long, seq string")
    assert encode.data_matrices(own).count() == 80
    # counted, numbered and counted by bucket
    assert seen.value <= 3 * 40


def test_hits_are_made_once_for_redundancy(spark):
    hits = pd.DataFrame({"motif_id": [1, 2] * 20, "seq_id": [i // 2 for i in range(40)], "pos": [3, 3] * 20, "comp": [False] * 40, "len": [8, 8] * 20})
    own, seen = once(spark, spark.createDataFrame(hits, "motif_id long, seq_id long, pos int, comp boolean, len int"), "motif_id long, seq_id long, pos int, comp boolean, len int")
    q = spark.createDataFrame([(i, "ACGTTGCAACGGTATT") for i in range(20)], "seq_id long, seq string")
    out = merge.remove_redundancy(own, q, 16)
    assert {tuple(r) for r in out.collect()} == {(1, i, 3, False, 8) for i in range(20)}
    assert seen.value == 40


def test_only_counts_are_shuffled(spark):
    q = spark.createDataFrame([(i, "ACGTTGCAACGGTATTNACG") for i in range(30)], "seq_id long, seq string")
    hits = q.select(F.lit(1).cast("long").alias("motif_id"), "seq_id", F.lit(6).alias("pos"), (F.col("seq_id") % 2 == 0).alias("comp"), F.lit(7).alias("len"))
    for made in (refine.expansion(hits, q), matrices.count_matrix(matrices.windows(hits, q))):
        # no row for each letter, and no group for each word
        assert "explode" not in plan(made).split("MapInArrow")[1] and "word#" not in plan(made).split("MapInArrow")[0].split("Exchange")[-1]
    letters = {(r.side, r.step): (r.A, r.C, r.G, r.T) for r in refine._letters(hits, q, False, None).collect()}
    # five letters before and eight behind on one strand, and the other way round on the other; N counts for none
    assert letters["left", 1] == (15, 0, 0, 15) and letters["left", 8] == (0, 15, 0, 0) and letters["right", 8] == (0, 0, 15, 0) and ("left", 9) not in letters
    assert plan(intervals.union(hits)).count("Exchange") == 1
    assert plan(queries._klet_counts(q, 2)).count("Exchange") == 1


def test_scores_by_four_columns(spark):
    rng = np.random.default_rng(3)
    mats = {m: rng.normal(size=(n, 4)) for m, n in ((1, 3), (2, 4), (3, 9))}
    seq = "ACGTTGCANCGGTATTGACA"
    got = {(r.motif_id, r.pos, r.comp): r.score for r in scan.scan(spark.createDataFrame([(1, seq)], "seq_id long, seq string"), mats).collect()}
    want = {}
    for m, w in mats.items():
        for comp in (False, True):
            x = w[::-1, ::-1] if comp else w
            for p in range(len(seq) - len(w) + 1):
                score = sum(x[i, "ACGT".index(c)] for i, c in enumerate(seq[p : p + len(w)]) if c != "N")
                if score > 0:
                    want[m, p + 1, comp] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert len(scan.blocks(mats[3])) == 3


def test_gates_and_places_as_plain_loops():
    rng = np.random.default_rng(2)
    zy = np.maximum(rng.normal(size=(20, 7, 6)), 0)
    zy[3], zy[4] = 0, 1
    want = np.array([(z >= (np.median(z[z > 0]) if (z > 0).any() else 0)).astype(float) for z in zy])
    assert (syntax.gate(zy) == want).all() and syntax.gate(zy.astype(np.float32)).dtype == np.float32
    code, filters = rng.random((3, 10, 5)), rng.random((5, 4, 6))
    placed = np.zeros((3, 13, 6))
    for n, c, k in np.ndindex(code.shape):
        placed[n, c : c + 4] += code[n, c, k] * filters[k]
    assert np.allclose(tape.place_arrays(code, filters), placed)


def test_each_block_of_a_step_is_a_task(spark):
    """Blocks that hash alike made one task of two, and files of texts set the number of tasks that encode."""
    q = spark.createDataFrame([(i, "".join("ACGT"[(i * j) % 7 % 4] for j in range(24)), i % 6) for i in range(60)], "seq_id long, seq string, block long").coalesce(1)
    shape = syntax.Shape(filters=3, width=4, syntax=2, height=3, sparsity=4, code_passes=1, filter_passes=1)
    first = syntax.initial(shape, 1)
    slope, spent, n = syntax.summed_slopes(q, first, shape, 6)
    whole, value = syntax.slopes(syntax.one_hot([r.seq for r in q.collect()]).astype(np.float32), first, shape)
    assert n == 60 and abs(spent - value) < 1e-3 * value
    model = syntax.Model(shape, first)
    assert model.encode(q).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism


def test_alignments_are_counted_once(spark, monkeypatch):
    """However many merges there are, hits meet their sequences twice: for the matrices, and for the letters around them."""
    passage = "TGACGTCATCAGGTCAGGCATTCC"
    rng = random.Random(5)
    texts = ["".join(rng.choice("ACGT") for _ in range(18)) + passage + "".join(rng.choice("ACGT") for _ in range(18)) for _ in range(40)]
    rows = [(m, q, 19, False, 8 + 2 * m) for m in range(1, 9) for q in range(40)]
    counted = []
    plain = matrices.windows
    monkeypatch.setattr(matrices, "windows", lambda h, s: counted.append(1) or plain(h, s))
    seq = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    left, decided = merge.alignment_decisions(spark.createDataFrame(rows, "motif_id long, seq_id long, pos int, comp boolean, len int"), seq, 60)
    assert len(decided) == 7 and len(counted) == 1
    assert {tuple(r) for r in left.select("motif_id", "pos", "comp", "len").collect()} == {(8, 19, False, 24)} and left.count() == 320


def test_letters_around_hits_equal_widened_windows(spark):
    """Counts around hits of both strands give the matrices of their widened hits, at the sequences' edges as well, however little a task holds."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("ACGTN") for _ in range(rng.choice((30, 28)))) for _ in range(60)]
    rows = [(m, q, rng.randint(1, 24), rng.random() < 0.5, 5 + m) for m in (1, 2) for q in range(60) for _ in range(3)]
    seq = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    hits = spark.createDataFrame(rows, "motif_id long, seq_id long, pos int, comp boolean, len int")
    around = merge.Around(merge.surroundings(hits, seq, 29, 15), {1: 6, 2: 7})
    around.fetch([1, 2])
    for m, front, back, turned in ((1, 0, 0, False), (1, 3, 5, True), (2, 8, 0, False), (2, 1, 4, True)):
        wide = merge.enlarged(hits.filter(hits.motif_id == m), front, back, turned, 29)
        want = merge.matrices_of(matrices.count_matrix(matrices.windows(wide, seq)))
        assert (around.widened(m, front, back, turned) == want[m]).all()
    assert around.widened(1, 40, 0, False) is None


def test_mining_meets_triples_twice(spark, monkeypatch):
    """Which patterns are enriched is read from their supports, not from their hits."""
    rng = random.Random(7)
    code = spark.createDataFrame([(s, p, rng.randint(0, 1), float(rng.randint(1, 9)), "w") for s in range(80) for p in (1, 4, 9, 13)], "seq long, position int, fil int, mag double, tie string")
    merged = patterns.merged_levels(code, DEFAULT.levels, DEFAULT.base_quantile, DEFAULT.height)
    want = {tuple(r) for r in merged.select(*patterns.KEY).collect()}
    monkeypatch.setattr(patterns, "merged_levels", None)
    got = discover.mined(code)
    assert got.select("motif_id").distinct().count() == len(want) > 1


def test_leading_triples_count_places(spark):
    """Above any mark there are as many leading triples as places of patterns, with events of one position and filter as well, so places needn't be grouped; with
    null magnitudes the levels are what grouping says."""
    rng = random.Random(10)
    rows = [(s, rng.randint(1, 4), rng.randint(0, 1), float(rng.randint(1, 6)), f"w{i}") for s in range(150) for i in range(rng.randint(2, 7))]
    schema = "seq long, position int, fil int, mag double, tie string"
    triples = patterns.triplets(spark.createDataFrame(rows, schema))
    for mark in (0.0, 1.5, 3.0, 4.5):
        own = triples.filter(F.col("min_mag") > mark)
        assert own.filter("lead").count() == own.select(*patterns.KEY, "seq", "pos").distinct().count() < own.count()
    some = [(s, p, f, None if s % 3 == 0 and rng.random() < 0.3 else m, t) for s, p, f, m, t in rows]
    code = spark.createDataFrame(some, schema)
    levels = (0.05, 0.5)
    got = {tuple(r)[:7]: (r.hits, r.hits_with_base) for r in patterns.merged_levels(code, levels, least=3).collect()}
    low, *marks = patterns.quantiles(code, [DEFAULT.base_quantile, *levels])
    hits, base = Counter(), Counter()
    rows = [(tuple(r)[:6], (r.seq, r.pos), r.min_mag) for r in patterns.triplets(code).collect() if r.min_mag is not None]
    for k, _, m in rows:
        base[k] += m > low
    for key, (n, both) in got.items():
        mark = marks[levels.index(key[6])]
        own = [(place, m) for k, place, m in rows if k == key[:6]]
        hits[key] = sum(m > mark for _, m in own)
        assert (n, both) == (hits[key], len({p for p, m in own if m > mark or (base[key[:6]] > DEFAULT.base_support and m > low)}))
    assert len(got) > 5


def word_windows_of(texts, letters, flank, first):
    """(motif, place from 1, window) of all words with their flanks."""
    for t in texts:
        for p in range(len(t) - letters - 2 * flank + 1):
            word = t[p + flank : p + flank + letters]
            yield first + sum("ACGT".index(c) * 4 ** (letters - 1 - i) for i, c in enumerate(word)), p + 1, t[p : p + letters + 2 * flank]


def test_windows_are_counted_where_they_are_read(spark):
    """Words' windows meet no join and make no rows, and hits are never sent to all tasks, however small Spark takes them to be."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(70)]
    own = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    for sizes in ((4, 2, 1), (3, 1, 1001)):
        want = Counter((m, o, c) for m, _, window in word_windows_of(texts, *sizes) for o, c in enumerate(window, 1))
        counted = queries.window_counts(own, *sizes)
        assert "Join" not in plan(counted) and "Generate" not in plan(counted).split("MapInArrow")[1]
        assert {(r.motif_id, r.offset, r.base): r.cnt for r in counted.collect() if r.cnt} == want
    hits = spark.range(5).selectExpr("id motif_id", "id seq_id", "1 pos", "false comp", "8 len")
    for made in (matrices.windows(hits, own), refine.expansion(hits, own), merge.surroundings(hits, own, 20, 12), intervals.jaccard(intervals.union(hits))):
        assert "SortMergeJoin [seq_id" in plan(made)


def test_places_of_windows_are_counted_where_they_are_read(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.choice((5, 18, 20)))) for _ in range(70)]
    own = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    for sizes in ((4, 2, 1), (3, 1, 1001)):
        placed = queries.window_places(own, *sizes)
        assert {(r.motif_id, r.pos, r.comp): r.n for r in placed.collect()} == Counter((m, p, False) for m, p, _ in word_windows_of(texts, *sizes))
        assert "Join" not in plan(placed)


def test_sparse_entries_and_bands_as_plain_loops():
    """Codes of a few entries meet their own windows only, and many filters of few letters make two widths at once; both are what loops say."""
    rng = np.random.default_rng(4)
    code = rng.random((4, 11, 9)) * (rng.random((4, 11, 9)) < 0.06)
    code[2] = 0
    for letters in (7, 3):
        filters, wide = rng.random((9, 5, letters)), rng.random((4, 15, letters))
        placed, sums, scores = np.zeros((4, 15, letters)), np.zeros((9, 5, letters)), np.zeros(code.shape)
        for n, c, k in np.ndindex(code.shape):
            placed[n, c : c + 5] += code[n, c, k] * filters[k]
            sums[k] += code[n, c, k] * wide[n, c : c + 5]
            scores[n, c, k] = (wide[n, c : c + 5] * filters[k]).sum()
        assert np.allclose(tape.place_arrays(code, filters), placed)
        at = tape.Entries.of(code != 0)
        found = at.windows(wide)
        assert np.allclose(at.outer(code, found, letters), sums) and np.allclose(at.correlate(found, filters), scores * (code != 0))
        for f, other in ((tape.place, filters), (tape.outer, wide)):
            got = []
            for entries in (None, at):
                a, b = tape.Value(code), tape.Value(other)
                got.append(tape.gradients((f(a, b, entries) * (1.0 + f(a, b, entries).x)).sum(), {"a": a, "b": b}))
            assert np.allclose(got[0]["a"] * (code != 0), got[1]["a"]) and np.allclose(got[0]["b"], got[1]["b"])
    assert tape.Entries.of(np.ones((2, 3, 4))) is None


def test_gradients_copy_few_windows(monkeypatch):
    """A batch's gradient copies windows of whole signals where a code is dense, not for each of its entries, and the encoding keeps nothing for gradients."""
    cells = []
    plain = tape.windows
    monkeypatch.setattr(tape, "windows", lambda signal, width: cells.append(plain(signal, width)) or cells[-1])
    shape = syntax.Shape(filters=24)
    p, x = syntax.initial(shape), syntax.one_hot(["".join("ACGT"[(i * j + i) % 13 % 4] for j in range(60)) for i in range(1, 9)])
    syntax.slopes(x, p, shape)
    upper = 8 * 42 * shape.height * 2 * shape.filters
    # a window for each step of the upper layer and its two derivatives would be more than 50 times that
    assert sum(c.size for c in cells) < 30 * upper
    model = syntax.Model(shape, p)
    whole, events = model.codes(x), model.codes(x, upper=True)
    assert (whole.x.x == events.x.x).all() and not whole.x.made_of and tape.Value.remembers


def test_triples_are_counted_in_arrays(spark, monkeypatch):
    """Supports and hits of mining equal those of the triples' rows, with ties of position and filter, with few events and with codes that can't be numbered."""
    rng = random.Random(13)
    schema = "seq long, position int, fil int, mag double, tie string"
    rows = [(s, rng.randint(5, 14), rng.randint(0, 3), float(rng.randint(1, 9)), "w") for s in range(120) for _ in range(rng.randint(1, 9))]
    for odd in ([], [(3, 6, 1, None, "w")], [(3, 1 << 29, 2, 4.0, "w"), (3, 6, 2, 4.0, "w")]):
        code = spark.createDataFrame(rows + odd, schema)
        marks = patterns.quantiles(code, [0.01, 0.3, 0.3, 0.8])
        plain = patterns.triplets(code, 12)
        want = {tuple(r) for r in patterns.supports(plain, marks).filter("s0 > 0").select(*patterns.KEY, "s0", "s1", "s2", "s3").collect()}
        assert (triples.numbers(code, marks) is None) == bool(odd)
        got = triples.supports(code, marks, 12)
        assert {tuple(r) for r in got.select(*patterns.KEY, "s0", "s1", "s2", "s3").collect()} == want and got.count() == len(want) > 300
        keys = sorted(r[:6] for r in want)[::3] + [(0, 0, 77, 1, 2, 14), (0, 0, 1, 1, 999, 1011)]
        numbers = {k: i + 1 for i, k in enumerate(keys)}
        places = {(numbers[k], r.seq, r.pos, k[5]) for r in plain.collect() if r.min_mag is not None and r.min_mag > marks[1] and (k := tuple(r[:6])) in numbers}
        hits = triples.hits(code, keys, marks[1], 12)
        assert {tuple(r) for r in hits.select("motif_id", "seq_id", "pos", "len").collect()} == places and hits.count() == len(places) > 100
    # nothing makes a row of a triple
    code = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(patterns, "triplets", None)
    assert discover.mined(code, replace(DEFAULT, support_to=1)).select("motif_id").distinct().count() > 10


def test_marks_of_the_config_are_followed(spark):
    """Which support is enough, and which makes a base pattern, is the config's to say."""
    code = spark.createDataFrame([(s, 4 * k + 1, k, 1.0 + (k + s) % 3, "w") for s in range(60) for k in range(6)], "seq long, position int, fil int, mag double, tie string")
    nothing = replace(DEFAULT, support_to=10**6)
    assert not discover.mined(code, nothing).isEmpty() and discover.mined(code, replace(nothing, base_support=10**6)).isEmpty()


def test_a_task_hands_on_its_sums(spark):
    """Counts of words and of letters at edges don't grow with the batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(i % 7, "ACGTACGTAC"[: 4 + i % 3]) for i in range(3000)]
        words = spark.createDataFrame(rows, "motif_id int, word string").coalesce(1)
        made, want = matrices.count_matrix(words), Counter((m, o, c) for m, w in rows for o, c in enumerate(w, 1))
        assert {(r.motif_id, r.offset, r.base): r.cnt for r in made.collect() if r.cnt} == want
        sizes = []
        plain = matrices.summed_cells
        with mock.patch.object(matrices, "summed_cells", lambda some: sizes.append(some.count()) or plain(some)):
            matrices.count_matrix(words)
            with mock.patch.object(matrices, "HELD", 100):
                assert {(r.motif_id, r.offset, r.base): r.cnt for r in matrices.count_matrix(words).collect() if r.cnt} == want
        assert sizes[0] == 7 * (4 + 5 + 6)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
