"""Bases, strands, shuffled backgrounds and Markov models of sequences (seq_id, seq).  Positions count from 1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import written

try:  # the same function without OpenSSL's start-up, which is half of the time of short strings
    from _md5 import md5
except ImportError:
    from hashlib import md5

BASES = ("A", "C", "G", "T")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def bases(sequences: DataFrame) -> DataFrame:
    """(seq_id, pos, base): a row for each letter."""
    letters = F.filter(F.split("seq", ""), lambda c: c != "")
    return sequences.select("seq_id", F.posexplode(letters).alias("p", "base")).select("seq_id", (F.col("p") + 1).alias("pos"), "base")


def onehot(seq: Column) -> Column:
    """The letters as one array of 4 numbers each; other letters are zeros."""
    letters = F.filter(F.split(seq, ""), lambda c: c != "")
    return F.flatten(F.transform(letters, lambda c: F.array(*[(c == b).cast("int") for b in BASES])))


def column_counts(sequences: DataFrame) -> DataFrame:
    """(pos, a, c, g, t): how often each base stands at each position."""
    counted = bases(sequences).groupBy("pos")
    return counted.agg(*[F.count_if(F.col("base") == b).alias(b.lower()) for b in BASES])


def by_length(seqs: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points) of the strings of each length, rows x length."""
    sizes = np.array([len(s) for s in seqs], np.int64)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        yield own, np.frombuffer("".join(seqs[i] for i in own.tolist()).encode("utf-32-le"), np.uint32).reshape(len(own), size)


_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(b) for b in BASES]] = range(4)


def coded(points: np.ndarray) -> np.ndarray:
    """Code points as 0 to 3 for the bases and 4 for other letters."""
    return _CODE[np.minimum(points, 255)]


def letter_codes(word: str) -> np.ndarray:
    return coded(np.array([ord(c) for c in word], np.uint32))


def spelled(points: np.ndarray) -> list[str]:
    """The rows of code points as strings."""
    size = points.shape[1]
    text = np.ascontiguousarray(points, np.uint32).tobytes().decode("utf-32-le")
    return [text[i : i + size] for i in range(0, len(text), size)] if size else [""] * len(points)


def hash_orders(keys: list[str], size: int) -> np.ndarray:
    """For each key the places 1 to ``size`` (from 0) in the order of the MD5 of key and place."""
    ends = [b"%d" % i for i in range(1, size + 1)]
    digests = b"".join([md5(k + e).digest() for k in (k.encode() for k in keys) for e in ends])
    halves = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(len(keys), size, 2)
    order = np.argsort(halves[..., 0], axis=1, kind="stable")
    first = np.take_along_axis(halves[..., 0], order, 1)
    for r in np.flatnonzero((first[:, 1:] == first[:, :-1]).any(1)).tolist():
        order[r] = np.lexsort((halves[r, :, 1], halves[r, :, 0]))
    return order


def shuffled(sequences: DataFrame, salt: str = "") -> DataFrame:
    """(seq_id, seq) with each sequence's letters in the order of a hash of id and position: the same multiset, the same on each run."""
    key = F.concat(F.lit(salt), F.col("seq_id").cast("string"), F.lit(":"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = part.column(2).to_pylist()
                for own, points in by_length(part.column(1).to_pylist()):
                    order = hash_orders([keys[i] for i in own.tolist()], points.shape[1])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(spelled(np.take_along_axis(points, order, 1)), pa.string())], ["seq_id", "seq"])

    # a null id has no order
    own = sequences.filter((F.length("seq") > 0) & F.col("seq_id").isNotNull()).select("seq_id", "seq", key.alias("key"))
    return own.mapInArrow(run, f"seq_id {own.schema['seq_id'].dataType.simpleString()}, seq string")


def euler_shuffle(seq: str, rng: np.random.Generator, k: int = 2) -> str:
    """A random sequence with the same counts of all strings of ``k`` letters: a random Euler walk of the multigraph of strings of
    ``k - 1`` letters from the first to the last, whose last exits form a random tree towards the end (drawn by loop-erased random
    walks).  With ``k`` 1 the letters are permuted."""
    if k == 1:
        return "".join(rng.permutation(list(seq)).tolist())
    if len(seq) <= k:
        return seq
    nodes = [seq[i : i + k - 1] for i in range(len(seq) - k + 2)]
    out: dict[str, list[str]] = {}
    for a, b in zip(nodes, nodes[1:], strict=False):
        out.setdefault(a, []).append(b)
    last, exits = nodes[-1], {}
    done = {last}
    for start in out:
        at = start
        while at not in done:
            exits[at] = int(rng.integers(len(out[at])))
            at = out[at][exits[at]]
        at = start
        while at not in done:
            done.add(at)
            at = out[at][exits[at]]
    for letter, edges in out.items():
        if letter in exits:
            final = edges.pop(exits[letter])
            rng.shuffle(edges)
            edges.append(final)
        else:
            rng.shuffle(edges)
    walk, used = [nodes[0]], dict.fromkeys(out, 0)
    while (at := walk[-1]) in out and used[at] < len(out[at]):
        walk.append(out[at][used[at]])
        used[at] += 1
    return walk[0] + "".join(w[-1] for w in walk[1:])


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, scrambled (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def euler_shuffles(codes: np.ndarray, ids: np.ndarray, k: int, seed: int, letters: int = 4) -> np.ndarray:
    """What :func:`euler_shuffle` does, for rows of letter codes of one length at once, and with numbers drawn by hashes of row id and place.

    The tree of last exits is drawn by popping cycles: exits on a cycle are drawn anew until there is none, which is as random as
    loop-erased walks.
    """
    n, size = codes.shape
    if size < 2 or (k > 1 and size <= k):
        return codes
    stream = mixed(mixed(np.full(n, seed, np.uint64)) ^ ids.astype(np.int64).view(np.uint64))[:, None]

    def drawn(turn: int, many: int, of=slice(None)) -> np.ndarray:
        return (mixed(stream[of] ^ mixed(np.arange(many, dtype=np.uint64) + np.uint64(turn << 32))) >> np.uint64(11)).astype(np.float64) * 2.0**-53

    if k == 1:
        return np.take_along_axis(codes, np.argsort(drawn(0, size), 1, kind="stable"), 1)
    places, many = size - k + 2, letters ** (k - 1)
    nodes = np.zeros((n, places), np.int64)
    for j in range(k - 1):
        nodes = nodes * letters + codes[:, j : j + places]
    rows = np.arange(n)[:, None]
    # edges lie by node and, inside a node, in random order
    edges = places - 1
    order = np.argsort(nodes[:, :-1] + drawn(0, edges), 1, kind="stable")
    heads = np.take_along_axis(nodes[:, 1:], order, 1)
    counts = np.bincount((rows * many + nodes[:, :-1]).ravel(), minlength=n * many).reshape(n, many)
    starts = np.cumsum(counts, 1) - counts
    last = nodes[:, -1:]
    own = np.arange(many)[None]
    # what has no tree to grow: the last node, and nodes that don't occur
    settled = (counts == 0) | (own == last)
    exits = np.zeros((n, many), np.int64)
    live, fresh, turn = np.arange(n), ~settled, 0
    while len(live):
        turn += 1
        r, v = np.nonzero(fresh)
        at, free = live[r], drawn(turn, many, live)[r, v]
        exits[at, v] = starts[at, v] + np.minimum((free * counts[at, v]).astype(np.int64), counts[at, v] - 1)
        far, reach = np.where(settled[live], own, np.take_along_axis(heads[live], np.minimum(exits[live], edges - 1), 1)), 1
        while reach < many:
            far, reach = np.take_along_axis(far, far, 1), 2 * reach
        # wherever many steps end there is a cycle or a settled node
        fresh = np.zeros((len(live), many), bool)
        np.put_along_axis(fresh, far, True, 1)
        fresh &= ~settled[live]
        more = fresh.any(1)
        live, fresh = live[more], fresh[more]
    # the last exit changes places with the last edge of its node
    r, v = np.nonzero(~settled)
    a, b = exits[r, v], starts[r, v] + counts[r, v] - 1
    heads[r, a], heads[r, b] = heads[r, b], heads[r, a]
    out = np.empty_like(codes)
    out[:, : k - 1] = codes[:, : k - 1]
    flat, base_n, base_e, at, used = heads.ravel(), np.arange(n) * many, np.arange(n) * edges, nodes[:, 0], starts.ravel().copy()
    for step in range(edges):
        here = base_n + at
        at = flat[base_e + used[here]]
        used[here] += 1
        out[:, k - 1 + step] = at % letters
    return out


#: Nodes of a walk up to which sequences are shuffled together.
MOST_NODES = 64
_LETTER = np.array([ord(b) for b in BASES], np.uint32)


def klet_shuffled(sequences: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(seq_id, seq) shuffled with the counts of strings of ``k`` letters kept; random numbers follow from each id, so partitioning
    doesn't matter.  Sequences of the four bases are shuffled together, others one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column(0).to_numpy()
                for own, points in by_length(part.column(1).to_pylist()):
                    codes = coded(points)
                    plain = (codes < 4).all(1) & (4 ** (k - 1) <= MOST_NODES)
                    seqs = spelled(points) if not plain.all() else [""] * len(own)
                    for i, s in zip(np.flatnonzero(plain).tolist(), spelled(_LETTER[euler_shuffles(codes[plain], ids[own[plain]], k, seed)]), strict=True):
                        seqs[i] = s
                    for i in np.flatnonzero(~plain).tolist():
                        x = int(ids[own[i]])
                        seqs[i] = euler_shuffle(seqs[i], np.random.default_rng([seed, x & 0xFFFFFFFF, x >> 32]), k)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(seqs, pa.string())], ["seq_id", "seq"])

    return sequences.select(F.col("seq_id").cast("long").alias("seq_id"), "seq").mapInArrow(run, "seq_id bigint, seq string")


def dinucleotide_shuffled(sequences: DataFrame, seed: int = 1) -> DataFrame:
    return klet_shuffled(sequences, 2, seed)


def frequencies(sequences: DataFrame) -> DataFrame:
    """(base, n, freq): shares of the bases."""
    counts = bases(sequences).groupBy("base").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("base", "n", (F.col("n") / F.col("total")).alias("freq"))


def transitions(sequences: DataFrame) -> DataFrame:
    """(base, next_base, n, p): a first-order Markov chain.  Pairs are cut from each sequence, without a window or shuffle of rows."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("seq") - 1), lambda i: F.substring(F.col("seq"), i, F.lit(2)))
    counts = sequences.filter(F.length("seq") > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = counts.select(F.substring("pair", 1, 1).alias("base"), F.substring("pair", 2, 1).alias("next_base"), "n")
    total = counts.groupBy("base").agg(F.sum("n").alias("total"))
    return counts.join(total, "base").select("base", "next_base", "n", (F.col("n") / F.col("total")).alias("p"))


def log_likelihood(sequences: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(seq_id, loglik) under the chain: the first base by its frequency, each other by its predecessor.  The 20 numbers of the
    model are gathered and become literals, so scoring needs no join."""
    first = {r.base: r.freq for r in frequencies(sequences).collect()}
    step = {r.base + r.next_base: r.p for r in (model or transitions(sequences)).collect()}
    table = F.create_map(*[F.lit(x) for kv in step.items() for x in kv])
    start = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    places = F.when(F.length("seq") > 1, F.sequence(F.lit(1), F.length("seq") - 1)).otherwise(F.array().cast("array<int>"))  # a sequence would count down
    total = F.aggregate(places, F.log(F.element_at(start, F.substring("seq", 1, 1))), lambda acc, i: acc + F.log(F.element_at(table, F.substring(F.col("seq"), i, F.lit(2)))))
    return sequences.select("seq_id", total.alias("loglik"))


def data_matrices(sequences: DataFrame, seed: int = 1) -> DataFrame:
    """(seq_id, split, kind, seq): train and test, each real and shuffled - letters for train, dinucleotides for test."""
    from .ranks import split

    real = written(split(sequences, "seq_id").withColumn("kind", F.lit("real")), "split")
    train = shuffled(real.filter("split = 'train'")).withColumn("split", F.lit("train"))
    test = dinucleotide_shuffled(real.filter("split = 'test'"), seed).withColumn("split", F.lit("test"))
    fake = train.unionByName(test).withColumn("kind", F.lit("shuffled"))
    return real.select("seq_id", "split", "kind", "seq").unionByName(fake.select("seq_id", "split", "kind", "seq"))


def labelled_matrices(sequences: DataFrame, ratio: float = 0.85, k_train: int = 1, k_test: int = 2, seed: int = 1) -> DataFrame:
    """``sequences(seq_id, seq, label)`` as (seq_id, split, kind, seq, label): the share ``ratio`` is train, and each part comes real and
    shuffled with its own ``k``.  A shuffled sequence keeps its label."""
    from .ranks import labelled_split

    real = written(labelled_split(sequences.select("seq_id", "seq", "label"), "seq_id", ratio), "split")
    parts = [real.withColumn("kind", F.lit("real"))]
    for name, k in (("train", k_train), ("test", k_test)):
        own = real.filter(F.col("split") == name)
        fake = shuffled(own) if k == 1 else klet_shuffled(own, k, seed)
        parts.append(own.select("seq_id", "label", "split").join(fake, "seq_id").withColumn("kind", F.lit("shuffled")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("seq_id", "split", "kind", "seq", "label")
