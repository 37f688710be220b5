"""External suffix sorting against sorting, in memory and on disk; logs, lookups, filters; minimisers; the R-tree against all pairs."""

import random
import threading

import numpy as np
import pytest

from quarry.llm import external, filters, induced, jaccard_join, scan, suffix_dedup


def brute(t, cap):
    t = t.tolist()
    order = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < cap and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp


def suffixes(t, symbols, cap, memory, folder, piece=None):
    store = external.Store(memory, str(folder))
    text = external.Log(store, "u2")
    for i in range(0, len(t), piece or len(t)):
        text.append(t[i : i + (piece or len(t))].astype(np.uint16))
    got = np.concatenate(list(induced.suffixes(store, text, symbols, cap)))
    text.free()
    assert not store.live
    return got["p"], got["lcp"], store


@pytest.mark.parametrize("memory", [300, 2000, 8000, 1 << 26])
def test_suffixes_and_common_prefixes(tmp_path, memory):
    rng = np.random.default_rng(memory)
    for trial in range(100):
        symbols = int(rng.integers(2, 7))
        a = rng.integers(1, symbols, int(rng.integers(0, 80)))
        if trial % 3 == 0 and len(a):
            a = np.tile(a[: max(1, len(a) // 4)], 5)
        if trial % 7 == 0 and len(a):
            a = np.repeat(a, rng.integers(1, 9, len(a)))
        if trial % 20 == 0:
            a = np.tile(rng.integers(1, symbols, 30), 20)
        cap = [100, 5, 8, 3][trial % 4]
        t = np.append(a, 0)
        p, lcp, _ = suffixes(t, symbols, cap, memory, tmp_path, [None, 7][trial % 2])
        assert (p.tolist(), lcp.tolist()) == brute(t, cap)
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("kind", ["random", "copies", "period", "runs"])
def test_recursion_on_disk(tmp_path, kind, monkeypatch):
    depth = []
    inner = induced.ordered
    monkeypatch.setattr(induced, "ordered", lambda *a: depth.append(a[2]) or inner(*a))
    rng = np.random.default_rng(3)
    n, memory = 6000, 4000
    a = rng.integers(1, 4, n)
    if kind == "copies":
        a = np.concatenate([a[i : i + 150] for i in rng.integers(0, n // 20, n // 150)])
    if kind == "period":
        a = np.tile(a[:37], n // 37)
    if kind == "runs":
        a = np.repeat(a[: n // 10], rng.integers(1, 20, n // 10))
    t = np.append(a, 0)
    p, lcp, store = suffixes(t, 4, 100, memory, tmp_path)
    order, common = induced.doubled(np.searchsorted(np.sort(t), t), 100)
    assert (p == order).all() and (lcp == common).all()
    # runs of random length make names that all differ: nothing is left for a recursion
    assert store.spilled > len(t) and len(depth) >= 2 - (kind == "runs") and all(2 * b <= a for a, b in zip(depth, depth[1:]))


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_shard_of_twenty_times_the_memory(tmp_path):
    """The process grows by a few times the bound and by what numpy keeps, not by the 40 bytes a symbol that whole arrays take."""
    memory = 12_000
    rng = np.random.default_rng(8)
    base = rng.integers(97, 123, 20_000).astype(np.uint8)

    def sort(times):
        shard, n = suffix_dedup.Shard(memory, str(tmp_path)), 0
        while n < times * memory:
            i = rng.integers(0, len(base) - 150, 100)
            c = base[i[:, None] + np.arange(150)].copy()
            c[np.arange(100), rng.integers(0, 150, 100)] = 5
            shard.add(c.ravel(), np.arange(101) * 150, suffix_dedup.pa.array(range(100), suffix_dedup.pa.int64()), np.zeros(100, np.int64), np.full(100, n))
            n += c.size
        return n, sum(b.num_rows for b in shard.ranges(100)), shard.store

    sort(2)
    before, peak, done = resident(), [0], threading.Event()
    watch = threading.Thread(target=lambda: [peak.append(max(peak.pop(), resident())) for _ in iter(lambda: done.wait(0.01), True)])
    watch.start()
    n, found, store = sort(20)
    done.set()
    watch.join()
    assert n >= 20 * memory and found > 0 and store.spilled > 20 * memory and not store.live
    assert peak[0] - before < 10 * n < 40 * n


def test_repeats_of_a_shard(tmp_path):
    rng = random.Random(5)
    for memory in (3000, 1 << 24):
        shard = suffix_dedup.Shard(memory, str(tmp_path))
        base = bytes(rng.choice(b"abc") for _ in range(400))
        contexts = []
        for i in range(60):
            at = rng.randrange(250)
            c = bytearray(base[at : at + rng.randrange(20, 150)])
            if rng.random() < 0.5:
                c[rng.randrange(len(c))] = 120
            contexts.append((bytes(c), None if i < 3 else i // 4, i, 1000 * i))
        data = np.frombuffer(b"".join(c for c, *_ in contexts), np.uint8)
        offsets = np.cumsum([0, *(len(c) for c, *_ in contexts)])
        shard.add(data, offsets, suffix_dedup.pa.array([k for _, k, *_ in contexts], suffix_dedup.pa.int64()), np.array([t for *_, t, _ in contexts]), np.array([a for *_, a in contexts]))
        got = set()
        for b in shard.ranges(20):
            for k, tie, start, end in zip(*(c.to_pylist() for c in b.columns)):
                got |= {(k, tie, p) for p in range(start, end - 19)}
        seen, want = set(), set()
        for c, k, tie, a in contexts:
            for i in range(len(c) - 19):
                if (w := c[i : i + 20]) in seen:
                    want.add((k, tie, a + i))
                seen.add(w)
        assert got == want and want


def test_sorted_streams_and_minima(tmp_path):
    rng = np.random.default_rng(1)
    for memory in (500, 1 << 20):
        store = external.Store(memory, str(tmp_path))
        out = external.Sorter(store, [("a", "i8"), ("b", "i8")], "a", "b")
        rows = rng.integers(0, 40, (3000, 2))
        for i in range(0, 3000, 37):
            x = np.zeros(len(rows[i : i + 37]), out.dtype)
            x["a"], x["b"] = rows[i : i + 37].T
            out.append(x)
        got = np.concatenate(list(out.stream()))
        assert list(zip(got["a"].tolist(), got["b"].tolist())) == sorted(map(tuple, rows.tolist()))
        d, lo, hi, at = external.Log(store, "u1"), external.Log(store, "i8"), external.Log(store, "i8"), external.Log(store, "i8")
        values = rng.integers(0, 255, 5000).astype(np.uint8)
        for i in range(0, 5000, 91):
            d.append(values[i : i + 91])
        a = rng.integers(0, 4999, 700)
        b = a + rng.integers(1, 5000 - a)
        for i in range(0, 700, 50):
            lo.append(a[i : i + 50]), hi.append(b[i : i + 50]), at.append(a[i : i + 50])
        least = np.concatenate(list(external.range_minima(store, d, lo, hi).chunks()))
        assert least.tolist() == [values[i + 1 : j + 1].min() for i, j in zip(a, b)]
        assert np.concatenate(list(external.fetched(store, d, at).chunks())).tolist() == values[a].tolist()


def test_queue_spills_in_order(tmp_path):
    store = external.Store(400, str(tmp_path))
    q, want = external.Queue(store, "i8"), []
    got = []
    for i in range(200):
        q.append(np.arange(i, i + 5))
        want += range(i, i + 5)
        if i % 40 == 39:
            got += q.pop().tolist()
    while (x := q.pop()) is not None:
        got += x.tolist()
    assert store.spilled > 0 and got == want and not store.live


def test_filters_are_sized_by_count(spark):
    assert filters.bits_for(0) == filters.LEAST_BITS and filters.bits_for(10**6) == 1 << 24 and filters.bits_for(10**6, 1 << 20) is None
    h = np.random.default_rng(1).integers(0, 2**63, 5000)
    df = spark.createDataFrame([(int(x),) for x in h], "h long")
    f = filters.Filter.of(df, "h", 1 << 20)
    others = np.random.default_rng(2).integers(0, 2**63, 5000)
    assert f.passes(h).all() and f.passes(others).mean() < 0.05
    assert filters.Filter.of(df, "h", 1 << 10).passes(others).all()


def test_equal_strings_have_one_minimiser():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 123, 300).astype(np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, int(n)).astype(np.uint8), shared, rng.integers(97, 123, 50).astype(np.uint8)]) for n in (3, 170)]
    hot = np.sort(suffix_dedup.minimisers(texts[0])[0][::2])
    for known in (None, hot):
        named = []
        for x in texts:
            h, a, e = suffix_dedup.minimisers(x, hot=known)
            assert a[0] == 0 and e[-1] == len(x) - 99 and (a[1:] == e[:-1]).all()
            named.append({x[i : i + 100].tobytes(): int(v) for v, s, t in zip(h, a, e) for i in range(s, t)})
        both = named[0].keys() & named[1].keys()
        assert len(both) >= 201 and all(named[0][w] == named[1][w] for w in both)
        if known is not None:
            assert not set(named[0].values()) & set(hot.tolist())


def test_gram_hashes_follow_bytes_only():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 256, 500).astype(np.uint8)
    h = suffix_dedup.gram_hashes(np.concatenate([x, x[100:200], x]))
    assert (h[100:169] == h[500:569]).all() and (h[:469] == h[600:1069]).all() and len(np.unique(h[:469])) == 469


def test_word_hashes_follow_bytes_only():
    texts = [b"Abc abc ABC", "é É x".encode(), b"", b"  abc"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    starts, ends, bounds = scan.words(data, offsets, "word")
    h = scan.word_hashes(data, starts, ends).tolist()
    assert np.diff(bounds).tolist() == [3, 3, 0, 1]
    assert len({h[0], h[1], h[2], h[6]}) == 1 and h[3] != h[4]
    assert scan.hash_of("abc") == h[0]


def test_tree_loses_no_pair():
    rng = random.Random(4)
    base = [rng.sample(range(10**6), 200) for _ in range(6)]
    sets = []
    for i in range(150):
        s = list(base[i % 6])
        for _ in range(rng.randint(0, 30)):
            s[rng.randrange(len(s))] = rng.randrange(10**9)
        sets.append(np.unique(scan.mix(np.array(s[: rng.randint(150, 200)], np.uint64))))
    sizes = np.array([len(s) for s in sets])
    vecs = [jaccard_join.vector(s) for s in sets]
    pts = jaccard_join.points(vecs, sizes, 64)
    q, p = jaccard_join.RTree(pts, sizes).query(pts, sizes, 85)
    found = set(zip(q.tolist(), p.tolist(), strict=True))
    pairs = 0
    for i in range(len(sets)):
        for j in range(len(sets)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in found
                pairs += 1
    assert pairs > 300 and len(found) < len(sets) ** 2


def test_long_texts_go_by_pieces():
    rng = np.random.default_rng(1)
    x = rng.choice(np.frombuffer(b"abcd  EF\n", np.uint8), 3_000_000)
    starts, ends, _ = scan.words(x, np.array([0, len(x)]), "word")
    assert (scan.word_hashes(x, starts, ends) == scan._word_hashes(x, starts, ends)).all()
    h, a, e = suffix_dedup.minimisers(x[:1_200_000], piece=100_000)
    whole, b, f = suffix_dedup.minimisers(x[:1_200_000], piece=900_000)
    assert (np.repeat(h, e - a) == np.repeat(whole, f - b)).all()
