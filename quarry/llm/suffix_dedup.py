"""Removal of repeated byte strings with suffix arrays built by external induced sorting.

A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a document with a smaller key, or earlier in the
same one.  Strings are judged on the input; matches never cross documents.

1. Equal texts meet by a 128-bit digest; all but the first go whole (if they hold a string at all).
2. Each string is named by its minimiser, the least hash of the ``GRAM``-byte strings in it (the leftmost of equals).  Equal
   strings have one minimiser at one place, so they can only be found among strings of the same minimiser.  Minimisers that
   occur once are ruled out; what is left is cut into contexts: the bytes of all strings that one occurrence of a minimiser names.
3. Equal contexts collapse to one before they are brought together; each but the first is a repeat as a whole.
4. A minimiser with more than ``most`` bytes of different contexts is hot.  Its strings are named anew, by the least hash of
   those grams that are not hot, which spreads them over many names, and they collapse and are weighed again, ``ROUNDS`` times at
   most.  What is still hot then is one shard, larger than the others.
5. Contexts of a name with two or more different ones are joined to shards of text, in the order of their documents, and suffix-sorted
   with their common prefixes (``induced.py``).  Runs of suffixes that agree in ``length`` bytes are equal strings, and all but the
   first in the shard's text are repeats.  A shard of any size is sorted in ``MEMORY`` bytes; what exceeds them is on disk, in the
   folder that the cluster shares.
6. Repeats are united to runs for each document, and only documents with runs are read again with their runs.

A passage that millions of documents share is one context for each map task.  Filters of hashes are sized by their count; with more
than ``MOST_BITS`` can tell apart, step 2 joins the minimisers exactly instead, and the other steps go without.

Defined results: a null or empty text has no bytes, nothing removed and the hash of nothing; texts shorter than ``length`` keep
everything, copies or not; null keys come first; documents with one key are ordered by a digest of their texts, and of rows equal in
key and text one is first and the others are copies; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .common import deleted, documents, dropped, partitions, released, scratch, small_batches, written
from .external import Log, Sorter, Store
from .filters import MOST_BITS, Filter
from .induced import suffixes

LENGTH = 100
#: Bytes of a minimiser; the window of starts it is the least of is LENGTH - GRAM + 1 wide.
GRAM = 32
#: Bytes of contexts from which a shard is closed and a minimiser is hot, and bytes in which a shard is sorted.
SHARD, MEMORY = 1 << 20, 64 << 20
#: How often strings of hot minimisers are named anew, and how many are hot at most.
ROUNDS, HOT = 3, 1_000_000
_BASE = 0xD6E8FEB86659FD93
_VALUES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bits of a place in the keys that minimisers are the least of.
PLACE = 20
CONTEXT = "h bigint, c binary, k bigint, tie bigint, a bigint"


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 63-bit hash of each ``gram`` bytes: differences of a running sum of values times powers, divided by the first power."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n - 1, base, np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * _powers[0][:n])])
    return scan.mix((sums[gram:] - sums[:-gram]) * _powers[1][: n - gram + 1]) >> np.uint64(1)


def minimisers(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, hot: np.ndarray | None = None, piece: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the strings of one text: (hash, first start, end of starts) of each run of starts that one minimiser names.

    Grams among the sorted hashes ``hot`` come last.  A long text is worked on by pieces of its starts; a run that crosses them
    becomes two of the same minimiser, which still meet.
    """
    if len(data) <= piece + length:
        return _minimisers(data, length, gram, hot)
    parts = []
    for at in range(0, len(data) - length + 1, piece):
        h, a, e = _minimisers(data[at : at + piece + length - 1], length, gram, hot)
        parts.append((h, a + at, e + at))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _minimisers(data: np.ndarray, length: int, gram: int, hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = len(data) - length + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    g = gram_hashes(data, gram)
    # hash and place in one number, so that the leftmost of equal hashes is the least; the hash's last bits give way
    key = (g >> np.uint64(PLACE)) << np.uint64(PLACE) | np.arange(len(g), dtype=np.uint64)
    if hot is not None and len(hot):
        key |= (_among(g.view(np.int64), hot)).astype(np.uint64) << np.uint64(63)
    w, width, least = length - gram + 1, 1, key
    while width < w:
        step = min(width, w - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    place = (least[:starts] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    cut = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    return g.view(np.int64)[place[cut]], cut, np.append(cut[1:], starts)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    for _, data, offsets in scan.blocks(column):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            yield data[a:b]


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _digest(x: np.ndarray) -> tuple[bytes, int]:
    """128 bits of a text's hash, and 63 of them as a number."""
    d = xxhash.xxh3_128_digest(x)
    return d, int.from_bytes(d[:8], "big") >> 1


class _Firsts:
    """One document, the first, of each text of ``length`` bytes or more.

    Texts whose digest may occur again (by a filter) are shuffled by it once, to a table; all others pass as they are.
    What is mapped over the firsts is composed with that choice, so a task has one Python worker.
    """

    def __init__(self, docs: DataFrame, t: DataFrame, length: int, most_bits: int):
        self.long = docs.filter(F.octet_length("t") >= length)
        again = written(t.filter(F.col("n_bytes") >= length).groupBy("dg", "tie").agg(F.sum("c").alias("c")).filter("c > 1").select("tie"), "suffix-again")
        self.again = Filter.of(again, "tie", most_bits)
        dropped(again)
        twice = self.long.mapInArrow(self.split(True), "k bigint, tie bigint, t binary, dg binary").groupBy("dg", "tie").agg(F.min("k").alias("k"), F.first("t").alias("t"), F.max(F.col("k").isNull()).alias("none"))
        self.copied = written(twice.select(F.when(F.col("none"), F.lit(None)).otherwise(F.col("k")).cast("long").alias("k"), "tie", "t"), "suffix-copied")

    def split(self, wanted: bool):
        again = self.again

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in _parts(batch):
                    ids = [_digest(x) for x in _texts(b.column(1))]
                    tie = np.array([i for _, i in ids], np.int64)
                    keep = again.passes(tie) == wanted
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tie), b.column(1), pa.array([d for d, _ in ids], pa.binary())], ["k", "tie", "t", "dg"]).filter(pa.array(keep))

        return run

    def map(self, f, schema: str) -> DataFrame:
        """``f`` over batches (k, tie, t) of all firsts."""
        once = self.split(False)
        return self.long.mapInArrow(lambda batches: f(once(batches)), schema).unionByName(self.copied.mapInArrow(f, schema))


class _Contexts:
    """Contexts cut out of texts, gathered to Arrow batches."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.rows, self.parts = 0, []

    def add(self, x: np.ndarray, h: np.ndarray, a: np.ndarray, e: np.ndarray, length: int, k: int | None, tie: int, base) -> None:
        """The contexts [a, e + length - 1) of the bytes ``x``, which begin at ``base`` of document (k, tie)."""
        if not len(h):
            return
        sizes = e - a + length - 1
        ends = np.cumsum(sizes)
        data = x[np.arange(ends[-1]) + np.repeat(a - (ends - sizes), sizes)]
        self.parts.append((h, sizes, data, k, tie, a + base))
        self.rows += len(h)

    def batch(self) -> pa.RecordBatch:
        counts = [len(p[0]) for p in self.parts]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in self.parts]))]).astype(np.int32)
        data = np.concatenate([p[2] for p in self.parts])
        c = pa.Array.from_buffers(pa.binary(), self.rows, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        of = pa.array(np.repeat(np.arange(len(counts)), counts))
        k, tie = pa.array([p[3] for p in self.parts], pa.int64()).take(of), pa.array([p[4] for p in self.parts], pa.int64()).take(of)
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[0] for p in self.parts])), c, k, tie, pa.array(np.concatenate([p[5] for p in self.parts]))], ["h", "c", "k", "tie", "a"])
        self.clear()
        return out


def _cut(length: int, chosen) -> callable:
    """Batches (k, tie, t[, more]) to contexts of the runs of minimisers that ``chosen(batch, i, h)`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Contexts()
        for batch in batches:
            for b in _parts(batch, 64):
                for i, (k, tie, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b.column(2)), strict=True)):
                    h, a, e = minimisers(x, length)
                    keep = chosen(b, i, h)
                    out.add(x, h[keep], a[keep], e[keep], length, k, tie, 0)
                    if out.rows > 8192:
                        yield out.batch()
        if out.rows:
            yield out.batch()

    return run


def _shared_contexts(firsts: _Firsts, shared: DataFrame, length: int, most_bits: int) -> DataFrame:
    """Contexts of the minimisers ``shared``.  If these are too many for a filter, occurrences are joined with them exactly."""
    spark = shared.sparkSession
    found = Filter.of(shared, "h", most_bits)
    if not found.open:
        return firsts.map(_cut(length, lambda b, i, h: np.flatnonzero(found.passes(h))), CONTEXT)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _parts(batch):
                own = [minimisers(x, length)[0] for x in _texts(b.column(2))]
                row = pa.array(np.repeat(np.arange(len(own)), [len(h) for h in own]))
                i = np.concatenate([np.arange(len(h), dtype=np.int32) for h in own]) if own else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)), pa.array(i)], ["k", "tie", "h", "i"])

    every = firsts.map(occurrences, "k bigint, tie bigint, h bigint, i int")
    places = every.join(shared.select(F.col("h").alias("h2")), F.col("h") == F.col("h2"), "left_semi").groupBy("k", "tie").agg(F.sort_array(F.collect_list("i")).alias("i")).withColumnsRenamed({"k": "k2", "tie": "tie2"})
    texts = firsts.map(lambda batches: (b.select(["k", "tie", "t"]) for b in batches), "k bigint, tie bigint, t binary")
    both = texts.join(written(places, "suffix-places"), (F.col("tie") == F.col("tie2")) & F.col("k").eqNullSafe(F.col("k2"))).select("k", "tie", "t", "i")
    return both.mapInArrow(_cut(length, lambda b, i, h: np.array(b.column(3)[i].as_py(), np.int64)), CONTEXT)


def _collapsed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one context of each kind, the first, with how often it occurs; ranges of all others, which are repeats as a whole)."""
    me = F.struct(F.col("k").isNotNull().alias("some"), F.col("k").alias("k"), F.col("tie").alias("tie"), F.col("a").alias("a"))
    distinct = written(found.groupBy("h", "c").agg(F.min(me).alias("me"), F.count("*").alias("times")).select("h", "c", "me.k", "me.tie", "me.a", "times"), "suffix-distinct")
    # contexts meet by their minimiser and two hashes of their bytes of 64 bits each, the second with another seed
    same = ["h", F.xxhash64("c").alias("ch"), F.xxhash64(F.lit(1), "c").alias("ch2")]
    first = distinct.filter("times > 1").select(*same, F.struct("k", "tie", "a").alias("first"))
    every = found.select(*same, F.struct("k", "tie", "a").alias("at"), "k", "tie", F.col("a").alias("from"), (F.col("a") + F.octet_length("c")).alias("to"))
    # one shuffle of narrow rows; a context with very many occurrences is split as a skewed join
    whole = every.join(first, ["h", "ch", "ch2"]).filter(~F.col("at").eqNullSafe(F.col("first"))).select("k", "tie", "from", "to")
    whole = written(whole, "suffix-whole")
    # the contexts' bytes are not needed twice on disk
    dropped(found)
    released(found.sparkSession)
    return distinct, whole


def _renamed(contexts: DataFrame, length: int, hot: list[np.ndarray]) -> DataFrame:
    """The strings of contexts of hot minimisers, named by their least gram that isn't hot, as contexts anew.

    ``hot`` has the hot names of each round; a name is a gram's hash, salted by the round in which it was given.
    """
    known = np.sort(np.concatenate([_unsalted(x, i) for i, x in enumerate(hot)]))
    given = len(hot)
    shared = contexts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Contexts()
        for batch in batches:
            for b in _parts(batch):
                for k, tie, base, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), _texts(b.column(0)), strict=True):
                    h, a, e = minimisers(x, length, hot=shared.value)
                    out.add(x, _salted(h, given), a, e, length, k, tie, base)
                if out.rows > 8192:
                    yield out.batch()
        if out.rows:
            yield out.batch()

    return contexts.select("c", "k", "tie", "a").mapInArrow(run, CONTEXT)


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    """A bijection of 63-bit names for each round; that of round 0 changes nothing."""
    return h ^ (salt * 0x1F3D5B79A2C4E688 & (1 << 63) - 1)


_unsalted = _salted


def repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", most: int = SHARD, memory: int = MEMORY, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(a row (k, dg, tie, n_bytes, sha, c) for each key and text with its count, texts with their ranges of repeats)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _parts(batch):
                rows = [(*_digest(x), len(x), hashlib.sha256(x).hexdigest()) for x in _texts(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, y) for c, y in zip(zip(*rows, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.string()], strict=True))], ["k", "dg", "tie", "n_bytes", "sha"])

    every = docs.mapInArrow(narrow, "k bigint, dg binary, tie bigint, n_bytes bigint, sha string").groupBy("k", "dg", "tie", "n_bytes", "sha").agg(F.count("*").alias("c"))
    t = written(every, "suffix-documents")
    firsts = _Firsts(docs, t, length, most_bits)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _parts(batch):
                h = [minimisers(x, length)[0] for x in _texts(b.column(2))]
                if h:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h))], ["h"])

    shared = written(firsts.map(named, "h bigint").groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "suffix-shared")
    del every
    released(spark)
    found = written(_shared_contexts(firsts, shared, length, most_bits), "suffix-contexts")
    dropped(shared)
    # contexts that occurred before: all strings of each but the first are repeats
    distinct, whole = _collapsed(found)
    used, hot, shards = [distinct, whole], [], []
    for _ in range(ROUNDS + 1):
        # a minimiser with one context has nothing to compare: by a filter its bytes are spared the way to the shards
        sizes = written(distinct.groupBy("h").agg(F.count("*").alias("m"), F.sum(F.octet_length("c")).alias("n_bytes")).filter("m > 1"), "suffix-sizes")
        used.append(sizes)
        several = Filter.of(sizes, "h", most_bits)
        over = sizes.limit(0)
        if len(hot) < ROUNDS:
            # at most HOT names have more than that share of all bytes
            total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
            over = sizes.filter(F.col("n_bytes") > max(most, total // HOT))
        over = over.select("h")
        large = np.sort(over.toArrow().column(0).to_numpy())
        own = distinct.select("h", "c", "k", "tie", "a")
        if not len(large):
            shards.append((own, several))
            break
        hot.append(large)
        side = F.broadcast(over)
        shards.append((own.join(side, "h", "left_anti"), several))
        again = written(_renamed(own.join(side, "h", "left_semi"), length, hot), "suffix-renamed")
        distinct, more = _collapsed(again)
        whole = whole.unionByName(more)
        used += [distinct, more]
    folder = scratch(spark, "suffix-sort")
    inside = None
    for own, several in shards:
        part = own.mapInArrow(lambda batches, f=several: (b.filter(pa.array(f.passes(b.column(0).to_numpy()))) for b in batches), CONTEXT)
        inside = part if inside is None else inside.unionByName(part)
    inside = inside.repartition(partitions(spark), "h").sortWithinPartitions("h", F.col("k").asc_nulls_first(), "tie", "a").mapInArrow(_shards(length, most, memory, folder), "k bigint, tie bigint, from bigint, to bigint")
    ranges = written(whole.unionByName(inside), "suffix-ranges")
    deleted(spark, folder)
    dropped(*used)
    released(spark)

    # documents with ranges, by a filter, are read again and meet their ranges
    ties = written(ranges.select("tie").distinct(), "suffix-ties")
    marked = Filter.of(ties, "tie", most_bits)
    dropped(ties)

    def with_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.select(["k", "tie", "t"]).filter(pa.array(marked.passes(b.column(1).to_numpy())))

    runs = ranges.groupBy("k", "tie").agg(F.collect_set(F.struct("from", "to")).alias("runs")).withColumnsRenamed({"k": "k2", "tie": "tie2"})
    texts = firsts.map(with_ranges, "k bigint, tie bigint, t binary")
    cut = texts.join(runs, (F.col("tie") == F.col("tie2")) & F.col("k").eqNullSafe(F.col("k2"))).select("k", "tie", "t", F.col("runs.from").alias("from"), F.col("runs.to").alias("to"))
    return t, cut


class Shard:
    """Contexts as one text, in a store: symbol 0 ends the text, 1 a context, and bytes count from 2."""

    OF = np.dtype([("begin", "i8"), ("k", "i8"), ("some", "?"), ("tie", "i8"), ("a", "i8"), ("size", "i8")])

    def __init__(self, memory: int, folder: str):
        self.store = Store(memory, folder)
        self.text, self.of, self.size = Log(self.store, "u2"), Log(self.store, self.OF), 0

    def add(self, data: np.ndarray, offsets: np.ndarray, k: pa.Array, tie: np.ndarray, a: np.ndarray) -> None:
        n, sizes = len(offsets) - 1, np.diff(offsets)
        text = np.ones(len(data) + n, np.uint16)
        text[np.arange(len(data)) + np.repeat(np.arange(n), sizes)] = data.astype(np.uint16) + 2
        of = np.zeros(n, self.OF)
        of["begin"], of["size"], of["tie"], of["a"] = self.size + offsets[:-1] - offsets[0] + np.arange(n), sizes, tie, a
        of["some"], of["k"] = np.asarray(k.is_valid()), k.fill_null(0).to_numpy()
        self.text.append(text)
        self.of.append(of)
        self.size += len(text)

    def later(self, length: int) -> Sorter:
        """Places whose next ``length`` symbols also stand at a place before them."""
        self.text.append(np.zeros(1, np.uint16))
        out = Sorter(self.store, [("p", "i8")], "p")
        least = None
        for x in suffixes(self.store, self.text, 258, length):
            p = x["p"]
            heads = np.flatnonzero(x["lcp"] < length)
            goes_on = not len(heads) or heads[0] > 0
            heads = np.concatenate([[0], heads]) if goes_on else heads
            first = np.minimum.reduceat(p, heads)
            of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(p))))
            rest = p != first[of]
            if goes_on and least is not None:
                # the run before goes on: the larger of the two least places is a repeat
                extra = max(int(first[0]), least)
                first[0] = min(int(first[0]), least)
                out.append(np.array([(extra,)], out.dtype))
            if rest.any():
                y = np.empty(int(rest.sum()), out.dtype)
                y["p"] = p[rest]
                out.append(y)
            least = int(first[-1])
        self.text.free()
        return out

    def ranges(self, length: int) -> Iterator[pa.RecordBatch]:
        """Runs of repeated strings: (k, tie, from, to)."""
        contexts = self.of.chunks()
        own = np.zeros(0, self.OF)
        for x in self.later(length).stream():
            p = x["p"]
            while len(p):
                # the contexts at hand, up to the end of the last one
                end = int(own["begin"][-1] + own["size"][-1]) if len(own) else -1
                n = int(np.searchsorted(p, end, "right"))
                if not n:
                    own = next(contexts)
                    continue
                yield from self._runs(p[:n], own, length)
                p = p[n:]
        self.of.free()

    def _runs(self, p: np.ndarray, own: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
        of = np.searchsorted(own["begin"], p, "right") - 1
        # strings that run over their context's end are none
        whole = p + length <= (own["begin"] + own["size"])[of]
        p, of = p[whole], of[whole]
        if not len(p):
            return
        first = np.concatenate([[True], (of[1:] != of[:-1]) | (p[1:] != p[:-1] + 1)])
        last = np.append(first[1:], True)
        row = own[of[first]]
        start = row["a"] + p[first] - row["begin"]
        yield pa.RecordBatch.from_arrays([pa.array(row["k"], mask=~row["some"]), pa.array(row["tie"]), pa.array(start), pa.array(start + (p[last] - p[first]) + length)], ["k", "tie", "from", "to"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32 if pa.types.is_binary(column.type) else np.int64, len(column) + 1, column.offset * (4 if pa.types.is_binary(column.type) else 8)).astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _shards(length: int, most: int, memory: int, folder: str):
    """Streams contexts in order of name and document, joins names with two or more to shards and yields ranges of repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(memory, folder), None

        def rows():
            """Batches of which the last row is held back while it is its name's first and a second may come."""
            nonlocal held
            for b in batches:
                if b.num_rows:
                    b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
                    held = None
                    h = b.column(0).to_numpy()
                    if h[-1] != (h[-2] if len(h) > 1 else last):
                        held, b, h = b.slice(len(h) - 1), b.slice(0, len(h) - 1), h[:-1]
                    if len(h):
                        yield b, h

        last = None
        for b, h in rows():
            fresh = np.concatenate([[h[0] != last], h[1:] != h[:-1]])
            alone = fresh & np.append(fresh[1:], held is not None and held.column(0)[0].as_py() != h[-1])
            last = int(h[-1])
            heads = np.flatnonzero(fresh)
            keep = ~alone
            # a shard is closed where a name begins
            data, offsets = _flat(b.column(1))
            at = 0
            for end in [*heads.tolist(), len(h)]:
                if end > at and (end == len(h) or shard.size + offsets[end] - offsets[at] > most):
                    _into(shard, b, data, offsets, at, end, keep)
                    at = end
                if end < len(h) and shard.size > most and fresh[end]:
                    _into(shard, b, data, offsets, at, end, keep)
                    at = end
                    yield from shard.ranges(length)
                    shard = Shard(memory, folder)
        if shard.size:
            yield from shard.ranges(length)

    return run


def _into(shard: Shard, b: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, at: int, end: int, keep: np.ndarray) -> None:
    own = np.flatnonzero(keep[at:end]) + at
    if not len(own):
        return
    sizes = offsets[own + 1] - offsets[own]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bytes_ = data[np.arange(ends[-1]) + np.repeat(offsets[own] - ends[:-1], sizes)]
    take = pa.array(own)
    shard.add(bytes_, ends, b.column(2).take(take), b.column(3).to_numpy()[own], b.column(4).to_numpy()[own])


def united(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs; runs that touch are one."""
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(end[by])
    first = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[first], reach[np.append(np.flatnonzero(first)[1:], len(start)) - 1]


def removed(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document; ``bounds`` are those of :func:`repeats`."""
    t, cut = repeats(docs, length, key, text, **bounds)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _parts(batch):
                rows = []
                for x, start, end in zip(b.column(2), b.column(3), b.column(4), strict=True):
                    x = x.as_py()
                    a, e = united(np.array(start.as_py(), np.int64), np.array(end.as_py(), np.int64))
                    rest = hashlib.sha256()
                    at = 0
                    for i, j in zip(a.tolist(), e.tolist(), strict=True):
                        rest.update(x[at:i])
                        at = j
                    rest.update(x[at:])
                    rows.append((int((e - a).sum()), len(a), rest.hexdigest()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, y) for c, y in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string()], strict=True))], ["k2", "tie2", "n_removed", "n_spans", "kept"])

    changed = cut.mapInArrow(kept, "k2 bigint, tie2 bigint, n_removed bigint, n_spans bigint, kept string")
    least = t.groupBy(F.col("dg").alias("d")).agg(F.min(F.struct(F.col("k").isNotNull().alias("some"), F.col("k").alias("k"))).alias("m"))
    rows = t.join(least, F.col("dg") == F.col("d")).withColumn("first", F.col("k").eqNullSafe(F.col("m.k"))).drop("d", "m")
    rows = rows.join(changed, (F.col("tie") == F.col("tie2")) & F.col("k").eqNullSafe(F.col("k2")) & F.col("first"), "left")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
    copy = (~F.col("first") | (F.col("i") > 1)) & (F.col("n_bytes") >= length)
    return rows.select(
        F.col("k").alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir))
