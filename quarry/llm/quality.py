"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a linear function of features of its bytes and words.  The chance that one document is preferred to
another is the logistic function of their strengths' difference; the weights minimise the logistic loss over preference pairs
(a document marked 1 over one marked 0), by Newton's method on feature differences.  The cut is a quantile of the strengths of
the labelled sample, at the share of documents marked 0, and the score is the logistic of the strength, shifted so that the cut
scores ``CUT``.

The model is a few dozen numbers, learned on the driver from the features (not the texts) of at most ``SAMPLE`` labelled rows, chosen
by a hash of their keys; scoring is one narrow pass over whole texts without a shuffle.

Defined results: a null or empty text has zero features and is scored like any other; without both marks in the sample every
document scores 0.5; rows of labels without key or mark teach nothing; repeated rows are scored one by one.  Memory follows the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .common import documents
from .langid import fraction

#: Labelled rows that are learned from at most, and preference pairs drawn from them.
SAMPLE, PAIRS, SEED = 20_000, 60_000, 5
#: The score at the cut, which is where ``predicted`` becomes 1.
CUT = 0.3
#: Fixed classes of bytes.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "|", "#$%&*^~", "@/\\<>_=+", "\"'()[]{}-", " \t", "\n\r")
_CLASS = np.full(256, len(CLASSES) + 1, np.int64)
_CLASS[128:] = len(CLASSES)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c.encode())] = _i
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text."""
    out = []
    k = len(CLASSES) + 2
    for _, data, offsets in scan.blocks(column):
        n = len(offsets) - 1
        length = np.diff(offsets)
        share = _class_counts(data, length, k) / np.maximum(length, 1)[:, None]
        starts, ends, bounds = scan.words(data, offsets, "word")
        count = np.diff(bounds)
        of = np.repeat(np.arange(n), count)
        h = scan.word_hashes(data, starts, ends)
        distinct = _distinct(h, of, n) / np.maximum(count, 1)
        # five words in a row, where they lie in one text
        if len(h) >= 5:
            five = h[:-4].copy()
            for j in range(1, 5):
                five = scan.mix(five + h[j : len(h) - 4 + j])
            inside = of[:-4] == of[4:]
            runs = np.bincount(of[:-4][inside], minlength=n)
            fresh = _distinct(five[inside], of[:-4][inside], n) / np.maximum(runs, 1)
        else:
            runs, fresh = np.zeros(n), np.zeros(n)
        fresh = np.where(runs > 0, fresh, 1.0)
        wide = ends - starts
        mean = np.bincount(of, wide, n) / np.maximum(count, 1)
        spread = np.sqrt(np.maximum(np.bincount(of, wide.astype(float) ** 2, n) / np.maximum(count, 1) - mean**2, 0))
        short = np.bincount(of, wide <= 3, n) / np.maximum(count, 1)
        base = np.column_stack([share, np.sqrt(share), np.log1p(length), np.log1p(count), distinct, fresh, mean / 10, spread / 10, short])
        out.append(np.column_stack([base, np.log1p(length)[:, None] * base[:, [2 * k + 2, 2 * k + 3]], base[:, 2 * k :] ** 2]))
    return np.concatenate(out) if out else np.zeros((0, 0))


def _class_counts(data: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """texts x classes; a text that is a block of its own is counted piece by piece."""
    n = len(length)
    if n == 1:
        pieces = (data[a : a + scan.BLOCK] for a in range(0, len(data), scan.BLOCK))
        return sum((np.bincount(_CLASS[p], minlength=k) for p in pieces), np.zeros(k, np.int64))[None]
    return np.bincount(np.repeat(np.arange(n), length) * k + _CLASS[data], minlength=n * k).reshape(n, k)


def _distinct(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each text has."""
    own = scan.mix(h + scan.mix(of.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own)
    first = np.ones(len(own), bool)
    first[1:] = own[order][1:] != own[order][:-1]
    return np.bincount(of[order[first]], minlength=n)


class Ranker:
    """Weights of standardised features, and the cut."""

    def __init__(self, x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = SEED, ridge: float = 1e-3):
        self.fitted = bool(len(good)) and bool(good.any()) and not bool(good.all())
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = self._z(x)
        rng = np.random.default_rng(seed)
        better, worse = np.flatnonzero(good), np.flatnonzero(~good)
        d = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
        w = np.zeros(d.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
            gradient = d.T @ (p - 1) / pairs + ridge * w
            step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), gradient)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        self.cut = float(np.quantile(z @ w, 1 - good.mean()))

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        s = self._z(x) @ self.weights - self.cut + np.log(CUT / (1 - CUT))
        return np.round(1 / (1 + np.exp(-np.clip(s, -30, 30))), 6)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", mark: str = "quality") -> Ranker:
    """A ranker from ``labels`` (key, mark) and the texts of ``docs``, by at most ``sample`` rows of ``labels``."""
    own = labels.filter(F.col(key).isNotNull() & F.col(mark).isNotNull()).select(F.col(key).alias("_q_key"), F.col(mark).cast("int").alias("_q_mark"))
    total = own.count()
    if total > sample:
        own = own.filter(F.pmod(F.xxhash64("_q_key", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * 0.95 * sample / total))
    own = own.limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(2))
            if len(x):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["key", "mark", "x"])

    # at most ``sample`` short rows
    texts = docs.select(F.col(key).alias("_q_doc"), F.col(text).alias("_q_text"))
    rows = texts.join(F.broadcast(own), F.col("_q_doc") == F.col("_q_key")).select("_q_key", "_q_mark", "_q_text").mapInArrow(run, "key bigint, mark int, x array<double>").collect()
    rows.sort(key=lambda r: (r.key, r.mark))
    if not rows:
        return Ranker(np.zeros((0, 1)), np.zeros(0, bool))
    return Ranker(np.array([r.x for r in rows]), np.array([r.mark == 1 for r in rows]))


def scored(docs: DataFrame, model: Ranker, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(model.score(features(part.column(1))))], ["doc_id", "score"])

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, "doc_id bigint, score double")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = fraction(F.col("doc_id"), 5) == 0
    model = trained(docs, documents(spark, sf_dir, "labels").filter(~held))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
