"""Similarity join on word n-grams by Jaccard, with R-trees over count vectors.

A document's set is its distinct shingles (64-bit hashes).  Shingles are hashed into groups, and the counts by group are a point
of an R-tree.  Two sets share no more shingles than the sum of their coordinates' minima, and a set shares no more with anything
below a node than the sum of the minima with the node's upper corner, so a query descends only where that sum reaches the
overlap that the threshold asks for; what survives at the leaves is verified on the sets.

One tree over a corpus would not prune: at a tolerance of 15 % upper corners of unrelated documents cover each other.  So trees
stand in a forest: two sets with the threshold's similarity share at least one of each other's first ``n - ceil(t n) + 1``
shingles in any order that all documents share (the prefix principle), and there is one tree for each shingle in two or more
prefixes.  The order puts shingles that are frequent in prefixes last, so a passage that many documents hold brings none
together that don't agree in nearly everything.

1. Counts of prefix shingles in hash order give frequency classes, in a table of fixed size.
2. A narrow table: set id, size, count vector, prefix.  Copies have one set id.
3. A tree for each shared prefix shingle; its surviving pairs are reduced to a spanning forest on the spot.
4. Components of these forests are canopies: every pair that the threshold links lies in one.
5. In each canopy a tree again, and pairs that survive and aren't yet connected are verified on the sets.
6. Components of the verified links.

A group above ``BLOCK`` members is a tree over many tasks (``hot_links``).  Its members are first held against a few pivots, one task for
each block of them; those near one pivot are linked through it and need no comparison with each other.  What is near one pivot, or
near none, is cut into nodes of a block, whose upper corners are known to every block, and a member goes to those nodes only which
its bound reaches.  So a group of near copies costs a few copies of each member, whatever its size, and no pair is lost.

Filters of shared hashes are sized by their count.  Equal sets collapse to one before anything is paired.

Defined results: a null or blank text has an empty set, links with nothing and is its own component; fewer words than ``k`` are one
shingle; equal sets link; repeated rows are linked with each other; null keys take part and are passed over when a component's
least key is named; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .common import documents, dropped, masked, partitions, written
from .components import components
from .filters import Filter

#: Prefix count from which a shingle is frequent, and bytes of the table of frequency classes.
FREQUENT, SLOTS = 4, 1 << 22
#: Members of a block of a large group, and bytes of sets in one; pivots of a large group.
BLOCK, BLOCK_BYTES, PIVOTS = 2048, 16 << 20, 16
#: Occurrences from which a shingle goes to the trees without being looked at, and how many such shingles there are at most.
HOT_ROWS, HOT_SHINGLES = 4096, 1_000_000
#: Coordinates of a node's upper corner.
CORNER = 64
LEAF, FAN = 16, 8
TABLE = "n bigint, sid binary, vec binary, prefix array<bigint>"


# ---------------------------------------------------------------------------------------------- sets


def sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, data, offsets in scan.blocks(column):
        starts, ends, bounds = scan.words(data, offsets, "word")
        h = scan.word_hashes(data, starts, ends)
        n = max(0, len(h) - k + 1)
        g = np.full(n, k, np.uint64)
        for j in range(k):
            g = scan.mix(g + h[j : j + n])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(g[a : b - k + 1])
            elif b > a:
                x = np.full(1, b - a, np.uint64)
                for j in range(a, b):
                    x = scan.mix(x + h[j : j + 1])
                yield x
            else:
                yield np.zeros(0, np.uint64)


def least_overlap(n, m, percent: int):
    """Shared shingles that sets of n and m need: ceil(t (n + m) / (1 + t))."""
    return -(-(percent * (n + m)) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def groups_of(n: int) -> int:
    """Coordinates of the point of a set of n, so that counts stay small; powers of two, which fold onto each other."""
    return 64 if n < 1000 else 256 if n < 4000 else 1024


def vector(s: np.ndarray) -> bytes:
    g = groups_of(len(s))
    c = np.bincount((s >> np.uint64(20)).astype(np.int64) & (g - 1), minlength=g)
    return c.astype(np.uint8 if c.max(initial=0) < 256 else np.uint32).tobytes()


def points(vecs: list[bytes], sizes: np.ndarray, g: int) -> np.ndarray:
    """Points of g coordinates, larger ones folded."""
    out = np.empty((len(vecs), g), np.uint32)
    for i, v in enumerate(vecs):
        own = groups_of(int(sizes[i]))
        x = np.frombuffer(v, np.uint8 if len(v) == own else np.uint32).astype(np.uint32)
        out[i] = x.reshape(-1, g).sum(0) if own > g else x
    return out.astype(np.uint8) if out.size and out.max() < 256 else out


# ---------------------------------------------------------------------------------------------- R-tree


class RTree:
    """Bulk-loaded over points; nodes keep the upper corner and the range of sizes."""

    def __init__(self, pts: np.ndarray, sizes: np.ndarray):
        self.order = np.array(self._order(pts, np.argsort(sizes, kind="stable")), np.int64)
        p, s = pts[self.order], sizes[self.order]
        self.points, self.sizes = p, s
        self.levels = []
        width = LEAF
        at = np.arange(0, len(p), width)
        hi, lo_n, hi_n = np.maximum.reduceat(p, at), np.minimum.reduceat(s, at), np.maximum.reduceat(s, at)
        self.levels.append((hi, lo_n, hi_n))
        while len(hi) > 1:
            at = np.arange(0, len(hi), FAN)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, at), np.minimum.reduceat(lo_n, at), np.maximum.reduceat(hi_n, at)
            self.levels.append((hi, lo_n, hi_n))

    def _order(self, pts: np.ndarray, idx: np.ndarray) -> list[int]:
        """Splits at the median of the widest coordinate, so that leaves hold neighbours."""
        out, stack = [], [idx]
        while stack:
            x = stack.pop()
            if len(x) <= LEAF:
                out += x.tolist()
                continue
            sub = pts[x[:: max(1, len(x) // 256)]]
            c = int(np.argmax(sub.max(0).astype(np.int64) - sub.min(0)))
            x = x[np.argsort(pts[x, c], kind="stable")]
            half = (len(x) // (2 * LEAF)) * LEAF or LEAF
            stack += [x[half:], x[:half]]
        return out

    def query(self, pts: np.ndarray, sizes: np.ndarray, percent: int, chunk: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) index pairs that the bound lets through."""
        least_n, most_n = -(-percent * sizes // 100), 100 * sizes // percent
        q, node = np.repeat(np.arange(len(pts)), len(self.levels[-1][0])), np.tile(np.arange(len(self.levels[-1][0])), len(pts))
        for level in range(len(self.levels) - 1, -1, -1):
            hi, lo_n, hi_n = self.levels[level]
            fits = (hi_n[node] >= least_n[q]) & (lo_n[node] <= most_n[q])
            q, node = q[fits], node[fits]
            need = least_overlap(sizes[q], np.maximum(lo_n[node], least_n[q]), percent)
            fits = self._minima(pts, hi, q, node, chunk) >= need
            q, node = q[fits], node[fits]
            wide, total = (FAN, len(self.levels[level - 1][0])) if level else (LEAF, len(self.points))
            q, node = np.repeat(q, wide), (node[:, None] * wide + np.arange(wide)).ravel()
            q, node = q[node < total], node[node < total]
        fits = (self.sizes[node] >= least_n[q]) & (self.sizes[node] <= most_n[q])
        q, node = q[fits], node[fits]
        fits = self._minima(pts, self.points, q, node, chunk) >= least_overlap(sizes[q], self.sizes[node], percent)
        return q[fits], self.order[node[fits]]

    @staticmethod
    def _minima(a, b, i, j, chunk):
        out = np.empty(len(i), np.int64)
        for k in range(0, len(i), chunk):
            out[k : k + chunk] = np.minimum(a[i[k : k + chunk]], b[j[k : k + chunk]]).sum(1, dtype=np.int64)
        return out


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two trees."""

    def __init__(self, n: int, label: list | None = None):
        self.up = np.arange(n)
        if label is not None:
            first: dict = {}
            self.up = np.array([i if x is None else first.setdefault(x, i) for i, x in enumerate(label)], np.int64)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up[i] != self.up[j]


def linked(vecs: list[bytes], sizes: np.ndarray, percent: int, check: Callable[[int, int], bool] | None = None, block: int = 64, resident: np.ndarray | None = None, label: list | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that the bound, and ``check`` if given, let through.

    With ``resident``, pairs have a resident; members of one ``label`` (not None) are linked already.
    """
    forest = Forest(len(vecs), label)
    kinds = np.array([groups_of(int(n)) for n in sizes])
    for g in np.unique(kinds).tolist():
        own = np.flatnonzero(kinds == g)
        # sets of the next kind are folded; those beyond are too large to be similar
        both = np.flatnonzero((kinds == g) | (kinds == 4 * g))
        pts = points([vecs[i] for i in both], sizes[both], g)
        tree = RTree(pts, sizes[both])
        at = np.searchsorted(both, own)
        for k in range(0, len(own), block):
            rows = at[k : k + block]
            q, p = tree.query(pts[rows], sizes[both[rows]], percent)
            i, j = both[rows[q]], both[p]
            new = (i < j) | (kinds[j] != g)
            if resident is not None:
                new &= resident[i] | resident[j]
            i, j = i[new], j[new]
            new = forest.apart(i, j) if len(i) else np.zeros(0, bool)
            for a, b in zip(i[new].tolist(), j[new].tolist(), strict=True):
                if check is None or (forest.root(a) != forest.root(b) and check(a, b)):
                    forest.add(a, b)
    return forest.links


# ---------------------------------------------------------------------------------------------- tables


def frequency_classes(docs: DataFrame, text: str, k: int, percent: int) -> np.ndarray:
    """A table of ``SLOTS`` bytes: by a shingle's last bits, the logarithm of the largest prefix count that falls there.

    Any order that all documents share is right; this one puts what is frequent last.  Its size is fixed, and where shingles
    outnumber slots it grows coarse but the most frequent ones stay last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                own = [s[: prefix_size(len(s), percent)] for s in sets(b.column(0).slice(at, 1024), k) if len(s)]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], ["h"])

    counts = docs.select(f"`{text}`").mapInArrow(run, "h bigint").groupBy("h").agg(F.count("*").alias("c")).filter(F.col("c") >= FREQUENT)
    slots = counts.groupBy(F.pmod("h", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.max(F.floor(F.log2("c"))).cast("int").alias("class")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[slots.column(0).to_numpy()] = slots.column(1).to_numpy()
    return out


def ordered_prefix(s: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order of frequency class, then hash."""
    if not len(s):
        return s
    p = prefix_size(len(s), percent)
    own = classes[(s & np.uint64(SLOTS - 1)).astype(np.int64)]
    return s[np.argsort(own, kind="stable")[:p]] if own.any() else s[:p]


def _number(c: Column) -> Column:
    """Seven bytes of an id as a number."""
    return F.conv(F.hex(F.substring(c, 1, 7)), 16, 10).cast("long")


def sid_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


ROW = "g binary, sid binary, n bigint, vec binary, body binary"


def hot_and_others(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (ROW) of groups above a block, with ``nb``, how many blocks they have, and ``m``, their number; and all other rows."""
    sizes = rows.groupBy(F.col("g").alias("_h")).agg(F.count("*").alias("m"), F.sum(F.octet_length("body")).alias("_bytes"))
    sizes = sizes.withColumn("nb", F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.coalesce("_bytes", F.lit(0)) / BLOCK_BYTES)).cast("int")).filter("nb > 1").drop("_bytes")
    # each row here stands for more rows or bytes than a block has; beyond a million it is joined by a shuffle
    sizes = written(sizes, "jaccard-large")
    side = F.broadcast(sizes) if sizes.count() < 1_000_000 else sizes
    return rows.join(side, F.col("g") == F.col("_h")).drop("_h"), rows.join(side, F.col("g") == F.col("_h"), "left_anti")


def by_key(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over batches whose rows come key by key, in order of ``flag`` inside a key."""
    n = partitions(rows.sparkSession)
    return rows.repartition(n, "key").sortWithinPartitions("key", "flag", "sid").mapInArrow(run, schema)


def batches_of(out: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def similar(x: tuple, y: tuple, percent: int) -> bool:
    """Whether (n, vec, body) of two sets pass the bound and, where bodies are given, the comparison of the sets."""
    n, m = x[0], y[0]
    if 100 * min(n, m) < percent * max(n, m):
        return False
    g = groups_of(min(n, m))
    a, b = points([x[1]], np.array([n]), g)[0], points([y[1]], np.array([m]), g)[0]
    if np.minimum(a, b).sum(dtype=np.int64) < least_overlap(n, m, percent):
        return False
    return x[2] is None or agree(np.frombuffer(x[2], np.uint64), np.frombuffer(y[2], np.uint64), percent)


def agree(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def hot_links(hot: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span the components of similar members of each large group; ``hot`` is ROW with ``m`` and ``nb``.

    A member's link through its pivot leads to the first of the pivots that are linked with that one.
    """
    own = F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int")
    block = F.xxhash64("g", own)
    none = F.lit(None).cast("binary")
    members = hot.select(block.alias("key"), F.lit(1).alias("flag"), "g", "nb", "sid", "n", "vec", "body")
    # about PIVOTS of a group, by a hash, known to each of its blocks
    chosen = hot.filter(F.pmod(F.xxhash64("sid", F.lit("pivot")), F.ceil(F.col("m") / PIVOTS)) == 0).withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pivots = chosen.select(F.xxhash64("g", "_b").alias("key"), F.lit(0).alias("flag"), "g", "nb", "sid", "n", "vec", "body")

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, names, out = None, [], None, []
        types = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        for b in batches:
            for key, flag, g, nb, sid, n, vec, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != last:
                    last, held, names = key, [], None
                if not flag:
                    held.append((sid, (n, vec, body)))
                    continue
                if names is None:
                    # pivots that are linked are one label, the same in all blocks as they come in one order
                    forest = Forest(len(held))
                    for i, (_, x) in enumerate(held):
                        for j in range(i):
                            if forest.root(i) != forest.root(j) and similar(x, held[j][1], percent):
                                forest.add(j, i)
                    names = [held[forest.root(i)][0] for i in range(len(held))]
                label = next((names[i] for i, (p, x) in enumerate(held) if p == sid or similar((n, vec, body), x, percent)), None)
                out.append((g, nb, sid, n, vec, body, label))
            if out:
                yield batches_of(out, ["g", "nb", "sid", "n", "vec", "body", "label"], types)
                out = []

    labelled = written(by_key(members.unionByName(pivots), labels, "g binary, nb int, sid binary, n bigint, vec binary, body binary, label binary"), "jaccard-labelled")
    # nodes of a block of members with one label; not larger in bytes than a block on average
    counts = labelled.groupBy("g", "label").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)) / BLOCK_BYTES)).cast("int").alias("_of"))
    counts = counts.withColumnsRenamed({"g": "_g", "label": "_l"})
    part = F.pmod(F.xxhash64("sid", F.lit("node")), F.col("_of"))
    noded = written(labelled.join(counts, (F.col("g") == F.col("_g")) & F.col("label").eqNullSafe(F.col("_l"))).withColumn("node", F.xxhash64("g", F.coalesce("label", F.lit(b"")), part)).drop("_g", "_l", "_of"), "jaccard-nodes")

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, None, []
        for b in batches:
            for key, _, g, nb, _, n, vec, label in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = points([vec], np.array([n]), CORNER)[0].astype(np.uint32)
                if key != last:
                    if state:
                        out.append((last, *state[:3], state[3].tobytes(), *state[4:]))
                    last, state = key, [g, nb, label, x, n, n]
                else:
                    state[3], state[4], state[5] = np.maximum(state[3], x), min(state[4], n), max(state[5], n)
        if state:
            out.append((last, *state[:3], state[3].tobytes(), *state[4:]))
        if out:
            yield batches_of(out, ["node", "g", "nb", "label", "corner", "lo", "hi"], [pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()])

    nodes = by_key(noded.select(F.col("node").alias("key"), F.lit(0).alias("flag"), "g", "nb", "sid", "n", "vec", "label"), corners, "node bigint, g binary, nb int, label binary, corner binary, lo bigint, hi bigint")
    # every block of a group learns its nodes' corners: one small row for a block of members and a block that asks
    known = nodes.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(F.xxhash64("g", "_b").alias("key"), F.lit(0).alias("flag"), none.alias("sid"), F.col("lo").alias("n"), "hi", F.col("corner").alias("vec"), "label", "node")
    asking = noded.select(block.alias("key"), F.lit(1).alias("flag"), "sid", "n", F.lit(0).cast("long").alias("hi"), "vec", "label", "node")

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, ready, out = None, [], None, []
        for b in batches:
            for key, flag, sid, n, hi, vec, label, node in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != last:
                    last, held, ready = key, [], None
                if not flag:
                    held.append((node, n, hi, vec, label))
                    continue
                if ready is None:
                    ids: dict = {}
                    ready = (np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held]), np.array([np.frombuffer(h[3], np.uint32) for h in held]), ids, np.array([-1 if h[4] is None else ids.setdefault(h[4], len(ids)) for h in held]))
                to, lo, most, corner, ids, of = ready
                x = points([vec], np.array([n]), CORNER)[0]
                least = -(-percent * n // 100)
                fits = (to > node) & (most >= least) & (100 * lo <= 100 * (100 * n // percent)) & ((of < 0) | (of != ids.get(label, -2)))
                fits &= np.minimum(corner, x).sum(1, dtype=np.int64) >= least_overlap(n, np.maximum(lo, least), percent)
                out += [(sid, int(t)) for t in to[fits].tolist()]
            if len(out) > 4096:
                yield batches_of(out, ["sid", "to"], [pa.binary(), pa.int64()])
                out = []
        if out:
            yield batches_of(out, ["sid", "to"], [pa.binary(), pa.int64()])

    visits = written(by_key(known.unionByName(asking), routes, "sid binary, to bigint").withColumnRenamed("sid", "_s").distinct(), "jaccard-visits")
    # a node that more than a block visits is met in parts, each with the node's residents: as many rows as it has visitors
    parts = visits.groupBy(F.col("to").alias("_to")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_parts")).filter("_parts > 1")
    parts = written(parts, "jaccard-parts")
    parts = F.broadcast(parts) if parts.count() < 1_000_000 else parts
    of_parts = F.coalesce("_parts", F.lit(1))
    columns = ["sid", "n", "vec", "body", "label"]
    # a set that is in several groups has one body; it visits a node once
    once = noded.select(*columns).withColumnRenamed("label", "_label").groupBy("sid").agg(F.first("n").alias("n"), F.first("vec").alias("vec"), F.first("body").alias("body"))
    visitors = visits.join(once, F.col("_s") == F.col("sid")).join(parts, F.col("to") == F.col("_to"), "left")
    visitors = visitors.select(F.xxhash64("to", F.pmod(F.xxhash64("sid", F.lit("visit")), of_parts).cast("int")).alias("key"), F.lit(1).alias("flag"), "sid", "n", "vec", "body", none.alias("label"))
    residents = noded.join(parts, F.col("node") == F.col("_to"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), of_parts - 1)))
    residents = residents.select(F.xxhash64("node", "_part").alias("key"), F.lit(0).alias("flag"), *columns)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, guests, met, out = None, [], [], False, []

        def close(end: bool) -> None:
            """Residents among each other, once, and the guests so far against them."""
            nonlocal guests, met
            # residents of a label are linked through their pivot
            if own and (guests or (end and not met and own[0][4] is None)):
                every = own + guests
                sets = [np.frombuffer(x[3], np.uint64) if x[3] is not None else None for x in every]
                check = None if sets[0] is None else lambda i, j: agree(sets[i], sets[j], percent)
                links = linked([x[2] for x in every], np.array([x[1] for x in every], np.int64), percent, check, 64, np.arange(len(every)) < len(own), [x[4] for x in every])
                out.extend((every[i][0], every[j][0]) for i, j in links)
                met = True
            guests = []

        for b in batches:
            for key, flag, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != last:
                    close(True)
                    last, own, guests, met = key, [], [], False
                if not flag:
                    own.append(row)
                else:
                    guests.append(row)
                    if len(guests) >= BLOCK or sum(map(len, (x[3] or b"" for x in guests[-1:]))) * len(guests) > BLOCK_BYTES:
                        close(False)
            if len(out) > 4096:
                yield batches_of(out, ["a", "b"], [pa.binary(), pa.binary()])
                out = []
        close(True)
        if out:
            yield batches_of(out, ["a", "b"], [pa.binary(), pa.binary()])

    pivoted = noded.filter(F.col("label").isNotNull() & (F.col("label") != F.col("sid"))).select(F.col("sid").alias("a"), F.col("label").alias("b"))
    return pivoted.unionByName(by_key(residents.unionByName(visitors), compared, "a binary, b binary"))


def group_links(rows: DataFrame, percent: int, label: str) -> DataFrame:
    """Links (a, b) of similar members of all groups of ``rows`` (ROW), written."""
    rows = written(rows, f"jaccard-{label}")
    hot, others = hot_and_others(rows)

    def near(held):
        _, sids, ns, vecs, bodies = held
        sets = [None if b is None else np.frombuffer(b, np.uint64) for b in bodies]
        check = None if sets[0] is None else lambda i, j: agree(sets[i], sets[j], percent)
        return [(sids[i], sids[j]) for i, j in linked(vecs, np.array(ns, np.int64), percent, check)]

    links = grouped(others.withColumn("key", F.xxhash64("g")), ["g", "sid", "n", "vec", "body"], near)
    if not hot.isEmpty():
        links = links.unionByName(hot_links(hot, percent))
    out = written(links, f"jaccard-{label}-links")
    dropped(rows)
    return out


def grouped(rows: DataFrame, columns: list[str], links: Callable[[list[list]], list[tuple[bytes, bytes]]]) -> DataFrame:
    """Streams rows in order of ``key`` and yields the links of each group.  Keys that meet by chance only cost a look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [[] for _ in columns], []

        def close():
            return links(held) if len(held[0]) > 1 else []

        for b in batches:
            keys = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            cols = [b.column(i + 1).to_pylist() for i in range(len(columns))]
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                if a == e:
                    continue
                if keys[a] != last:
                    out += close()
                    last, held = keys[a], [[] for _ in columns]
                for h, c in zip(held, cols, strict=True):
                    h += c[a:e]
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        out += close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    n = partitions(rows.sparkSession)
    return rows.select("key", *columns).repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary")


def small_and_large(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (h, sid, n) as pairs (a, b) of groups that fit into half a leaf, and as members (h, a) of larger groups.

    A tree over so few points is one leaf, whose points are compared directly; near copies meet in nearly all of their prefix,
    and as pairs their many meetings collapse before vectors are fetched.  Groups are streamed, a few rows at a time.
    """
    most = LEAF // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []

        def close():
            out.extend((None, min(x, y), max(x, y)) for i, (x, n) in enumerate(held) for y, m in held[:i] if 100 * min(n, m) >= percent * max(n, m))

        for b in batches:
            for h, sid, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != last:
                    if held:
                        close()
                    last, held = h, []
                if held is None:
                    out.append((h, sid, None))
                    continue
                held.append((sid, n))
                if len(held) > most:
                    out += [(h, s, None) for s, _ in held]
                    held = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), [pa.int64(), pa.binary(), pa.binary()], strict=True)], ["h", "a", "b"])
                out.clear()
        if held:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), [pa.int64(), pa.binary(), pa.binary()], strict=True)], ["h", "a", "b"])

    n = partitions(rows.sparkSession)
    return rows.select("h", "sid", "n").repartition(n, "h").sortWithinPartitions("h").mapInArrow(run, "h bigint, a binary, b binary")


def _leaf(percent: int):
    """Pairs with sizes and points that the bound lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
            fits = np.zeros(b.num_rows, bool)
            need = least_overlap(n, m, percent)
            v, w = b.column(4).to_pylist(), b.column(5).to_pylist()
            for i in range(b.num_rows):
                g = groups_of(int(min(n[i], m[i])))
                x, y = points([v[i]], n[i : i + 1], g)[0], points([w[i]], m[i : i + 1], g)[0]
                fits[i] = np.minimum(x, y).sum(dtype=np.int64) >= need[i]
            yield b.filter(pa.array(fits)).select([0, 1])

    return run


def linked_sets(docs: DataFrame, k: int, percent: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(the key and TABLE of all documents, verified links (a, b) of set ids that span the components of similar different sets)."""
    spark = docs.sparkSession
    classes = spark.sparkContext.broadcast(frequency_classes(docs, text, k, percent))

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                own = list(sets(b.column(1).slice(at, 1024), k))
                prefix = [ordered_prefix(s, classes.value, percent) for s in own]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
                flat = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, 1024), pa.array([len(s) for s in own], pa.int64()), pa.array([sid_of(s) if len(s) else None for s in own], pa.binary()), pa.array([vector(s) for s in own], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    [key, "n", "sid", "vec", "prefix"],
                )

    t = written(docs.select(f"`{key}`", f"`{text}`").mapInArrow(table, f"`{key}` {docs.schema[key].dataType.simpleString()}, {TABLE}"), "jaccard-sets")
    shared = written(t.select(F.explode("prefix").alias("h")).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1"), "jaccard-shared")
    repeated = Filter.of(shared, "h")
    # a shingle of very many rows is not brought together to be counted; at most HOT_SHINGLES exceed that share of all
    total = shared.agg(F.sum("c")).first()[0] or 0
    hot = shared.filter(F.col("c") > max(HOT_ROWS, total // HOT_SHINGLES)).select(F.col("h").alias("_hot"))
    hot = F.broadcast(written(hot, "jaccard-hot"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefix = b.column(2)
            flat = prefix.flatten().to_numpy()
            owner = np.repeat(np.arange(b.num_rows), prefix.value_lengths().fill_null(0).to_numpy())
            keep = repeated.passes(flat) if len(flat) else np.zeros(0, bool)
            flat, owner = flat[keep], pa.array(owner[keep])
            for at in range(0, len(flat), 1 << 15):
                own = owner.slice(at, 1 << 15)
                yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + (1 << 15)]), b.column(0).take(own), b.column(1).take(own)], ["h", "n", "sid"])

    rows = t.select("n", "sid", "prefix").mapInArrow(candidates, "h bigint, n bigint, sid binary").distinct()
    known = rows.join(hot, F.col("h") == F.col("_hot"), "left")
    several = known.filter("_hot is not null").select("h", F.col("sid").alias("a"), F.lit(None).cast("binary").alias("b"))
    met = written(small_and_large(known.filter("_hot is null"), percent).unionByName(several), "jaccard-met")
    vectors = t.filter(F.col("sid").isNotNull()).groupBy("sid").agg(F.first("n").alias("n"), F.first("vec").alias("vec"))
    vectors = written(vectors, "jaccard-vectors")

    members = met.filter("b is null").select("h", F.col("a").alias("sid")).join(vectors, "sid")
    trees = group_links(members.select(F.hex("h").cast("binary").alias("g"), "sid", "n", "vec", F.lit(None).cast("binary").alias("body")), percent, "trees")
    pairs = met.filter("b is not null").select("a", "b").distinct()
    for side in "ab":
        pairs = pairs.join(vectors.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("vec").alias(f"v_{side}")), side)
    maybe = trees.unionByName(pairs.select("a", "b", "n_a", "n_b", "v_a", "v_b").mapInArrow(_leaf(percent), "a binary, b binary"))
    canopies = written(components(maybe), "jaccard-canopies")
    dropped(met, vectors, trees, shared)
    inside = Filter.of(written(canopies.select(_number(F.col("node")).alias("h")), "jaccard-inside"), "h")
    ids = canopies.select("node", "label")

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                rows = []
                for s in sets(b.column(0).slice(at, 1024), k):
                    sid = sid_of(s)
                    # the same bytes that ``_number`` takes
                    if len(s) and inside.passes(np.array([int.from_bytes(sid[:7], "big")], np.int64))[0]:
                        rows.append((sid, s.tobytes(), len(s), vector(s)))
                if rows:
                    yield batches_of(rows, ["sid", "set", "n", "vec"], [pa.binary(), pa.binary(), pa.int64(), pa.binary()])

    whole = docs.select(f"`{text}`").mapInArrow(full, "sid binary, set binary, n bigint, vec binary")
    whole = whole.groupBy("sid").agg(F.first("set").alias("body"), F.first("n").alias("n"), F.first("vec").alias("vec"))
    links = group_links(whole.join(ids, F.col("sid") == F.col("node")).select(F.col("label").alias("g"), "sid", "n", "vec", "body"), percent, "members")
    dropped(canopies)
    return t, links


def joined(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document: links at ``percent`` % Jaccard of word ``k``-grams."""
    t, links = linked_sets(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), k, percent, "doc_id", "text")
    labels = components(links).select(F.col("node"), F.col("label").alias("of"))
    own = t.select("doc_id", "n", "sid").join(labels, F.col("sid") == F.col("node"), "left").select("doc_id", "n", F.coalesce("of", "sid").alias("class"))
    own = written(own, "jaccard-classes")
    least = own.filter(F.col("class").isNotNull()).groupBy(F.col("class").alias("c")).agg(F.min("doc_id").alias("least"))
    return own.join(least, F.col("class") == F.col("c"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one with the least key (null keys last; of equal keys one is kept).

    A document with an empty set is a component of its own and stays.  Only ids and the ends of components are shuffled: dropped
    ids are broadcast if there are at most a million, else joined by a shuffle.  Rows with the same key and the same text are one
    document; rows with the same key and different texts are told apart by the text's hash.
    """
    docs, (key, text), back = masked(docs, key, text)
    me = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    t, links = linked_sets(docs.select(me.alias("_q_me"), F.col(text).alias("_q_text")), k, percent, "_q_me", "_q_text")
    labels = components(links)
    rows = t.join(labels, F.col("sid") == F.col("node"), "left").select(F.col("_q_me").alias("me"), F.coalesce("label", "sid").alias("class")).filter(F.col("class").isNotNull())
    rows = written(rows.groupBy("me", "class").agg(F.count("*").alias("c")), "jaccard-classes")
    keeps = rows.groupBy(F.col("class").alias("k")).agg(F.min("me").alias("keep"))
    ends = rows.join(keeps, F.col("class") == F.col("k")).select("me", (F.col("me") != F.col("keep")).alias("goes"), "c")
    ends = written(ends.filter(F.col("goes") | (F.col("c") > 1)), "jaccard-ends")
    few = ends.count() <= 1_000_000
    docs = docs.withColumn("_q_me", me)

    def side(of: DataFrame) -> DataFrame:
        of = of.select(F.col("me.key").alias("_q_k"), F.col("me.hash").alias("_q_h"))
        return F.broadcast(of) if few else of

    same = (F.col("_q_me.hash") == F.col("_q_h")) & F.col("_q_me.key").eqNullSafe(F.col("_q_k"))
    left = docs.join(side(ends.filter("goes")), same, "left_anti")
    again = ends.filter("not goes")
    if not again.isEmpty():
        # repeated rows of a key and a text that stays: one of them
        left = left.join(side(again), same, "left_anti").unionByName(left.join(side(again), same, "left_semi").dropDuplicates(["_q_me"]))
    return back(left)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir), k=4, percent=85)
