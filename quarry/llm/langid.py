"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, made from the letter's code point and the seed alone, so any alphabet will do and
no table is kept.  A trigram is bound from its letters' vectors, each permuted (rotated) by its place; a text's vector bundles
(adds up) those of all its trigrams; a language's prototype bundles the unit vectors of its sample texts.  What all prototypes
share, their mean, is taken off, and a text gets the language of the nearest prototype by cosine.

Letters are what Unicode calls letters, in lower case; all else is a blank, runs of blanks are one, and texts begin and end with
one, so any text with a letter has a trigram.

The model is languages x dimensions numbers.  It is learned from at most ``SAMPLE`` labelled texts, chosen by a hash of their
keys; predicting is one narrow pass over whole texts without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the language first in code-point order;
null labels teach nothing; without any labelled text all are ``und``; repeated rows are judged one by one.  Memory follows the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .common import documents, small_batches

DIMENSIONS, SEED = 512, 11
#: Labelled texts that are learned from at most.
SAMPLE = 12_000
UNKNOWN = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
#: Letters that are worked on at once; a longer text is worked on by pieces, with the same result.
PIECE = 1 << 18


class Hyper:
    """Letter vectors and the encoding of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.d, self.seed = dimensions, seed
        letters = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                letters[c] = ord(low) if len(low) == 1 and low.isalpha() else c
        self.letters = letters  # 0: not a letter
        self.known: dict[int, np.ndarray] = {}
        self.trigrams: dict[int, np.ndarray] = {}

    def letter(self, c: int) -> np.ndarray:
        """Bits of a hash of (seed, letter, word) as +1 and -1."""
        if c not in self.known:
            with np.errstate(over="ignore"):
                words = scan.mix(np.arange(-(-self.d // 64), dtype=np.uint64) + scan.mix(np.array([c * 1_000_003 + self.seed], np.uint64)))
            bits = np.unpackbits(words.view(np.uint8))[: self.d]
            self.known[c] = bits.astype(np.int8) * 2 - 1
        return self.known[c]

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of trigrams, which are given as three 21-bit code points."""
        if len(self.trigrams) > 40_000:
            self.trigrams.clear()
        out = np.empty((len(codes), self.d), np.float32)
        for i, code in enumerate(codes.tolist()):
            v = self.trigrams.get(code)
            if v is None:
                a, b, c = code >> 42, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF
                v = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
                self.trigrams[code] = v
            out[i] = v
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors (rows x dimensions) and whether the text has a letter."""
        out, some = np.zeros((len(texts), self.d), np.float32), np.zeros(len(texts), bool)
        rows, held = [], 0
        for i, t in enumerate(texts):
            if len(t or "") > PIECE:
                self._add_long(out, some, i, t)
            elif t:
                rows.append(i)
                held += len(t)
                if held > PIECE:
                    self._add(out, some, rows, texts)
                    rows, held = [], 0
        self._add(out, some, rows, texts)
        return out, some

    def _codes(self, text: str) -> np.ndarray:
        return self.letters[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)

    def _add_long(self, out, some, row: int, text: str) -> None:
        """A text by pieces: the last two letters of each go before the next, so every trigram is counted once."""
        carry = np.zeros(1, np.int64)
        for a in range(0, len(text) + 1, PIECE):
            # a blank ends the text
            x = np.concatenate([carry, self._codes(text[a : a + PIECE]), np.zeros(int(a + PIECE > len(text)), np.int64)])
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
            x = x[keep]
            self._bundle(out, some, np.array([row]), x, np.zeros(len(x), np.int64), 1)
            carry = x[-2:]

    def _add(self, out, some, rows, texts) -> None:
        if not rows:
            return
        parts = [texts[i] for i in rows]
        x = self._codes(" ".join(["", *parts, ""]))
        owner = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
        owner = np.concatenate([owner, owner[-1:]])[: len(x)]
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        self._bundle(out, some, np.asarray(rows), x[keep], owner[keep], len(parts))

    def _bundle(self, out, some, rows, x, owner, n) -> None:
        """Adds the trigrams of the letters ``x`` to the rows of their owners; blanks (0) are single."""
        if len(x) < 3:
            return
        # blank 0 is a letter of its own; the trigram belongs to its middle letter's text, and blanks end every text
        codes = (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]
        middle = owner[1:-1]
        # a trigram with a blank in its middle counts inside a text only
        whole = (x[1:-1] != 0) | ((owner[:-2] == owner[2:]) & (x[:-2] != 0) & (x[2:] != 0))
        codes, middle = codes[whole], middle[whole]
        if not len(codes):
            return
        some[rows[np.unique(middle)]] = True
        distinct, inverse = np.unique(codes, return_inverse=True)
        order = np.searchsorted(middle, np.arange(n + 1))
        for at in range(0, n, 256):
            end = min(n, at + 256)
            lo, hi = order[at], order[end]
            if hi > lo:
                used, local = np.unique(inverse[lo:hi], return_inverse=True)
                counts = np.bincount((middle[lo:hi] - at) * len(used) + local, minlength=(end - at) * len(used)).reshape(end - at, len(used)).astype(np.float32)
                out[rows[at:end]] += counts @ self.bound(distinct[used])


@lru_cache(maxsize=1)
def encoder() -> Hyper:
    """One encoder a Python worker: its letter table and known trigrams serve all tasks."""
    return Hyper()


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


class Model:
    """Prototypes by language, centred."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.languages = sorted(sums)
        raw = unit(np.array([sums[k] for k in self.languages], np.float64)) if sums else np.zeros((0, DIMENSIONS))
        self.mean = raw.mean(0) if len(raw) > 1 else np.zeros(raw.shape[1])
        self.prototypes = unit(raw - self.mean)

    def predict(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = unit(unit(vectors.astype(np.float64)) - self.mean) @ self.prototypes.T
        best = cosines.argmax(1)
        return best, np.clip(cosines[np.arange(len(best)), best], 0, 1)


def fraction(key: Column, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def learned(labelled: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Prototypes from at most ``sample`` rows of ``labelled``: at random by a hash of the key, about 5 % fewer so that the bound holds."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # the share to take comes from a count that reads no text; null texts only make the sample a little smaller
    total = labelled.filter(F.col(lang).isNotNull()).count()
    if total > sample:
        rows = rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * 0.95 * sample / total))
    d = DIMENSIONS

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hyper, own = encoder(), {}
        for b in batches:
            vectors, some = hyper.encode(b.column(1).to_pylist())
            for v, lang_of in zip(unit(vectors)[some], np.array(b.column(0).to_pylist(), object)[some], strict=True):
                own[lang_of] = own.get(lang_of, 0) + v.astype(np.float64)
        for k, v in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * d), pa.array(range(d), pa.int32()), pa.array(v)], ["lang", "i", "v"])

    parts = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(sums, "lang string, i int, v double")
    # languages x dimensions rows; rounding makes the sum independent of its order
    found: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "i").agg(F.round(F.sum("v"), 6).alias("v")).collect():
        found.setdefault(r.lang, np.zeros(d))[r.i] = r.v
    return Model(found)


def identified(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the columns of ``keep`` (all, unless named) pass through."""
    keep = docs.columns if keep is None else keep
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "_q_lang string", "_q_score double"])
    names = [*keep, "_q_lang", "_q_score"]
    # the text goes over once, also where it is kept
    place = keep.index(text) if text in keep else len(keep)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hyper = encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                vectors, some = hyper.encode(b.column(place).to_pylist())
                if model.languages:
                    best, score = model.predict(vectors)
                    langs = [model.languages[i] if s else UNKNOWN for i, s in zip(best, some, strict=True)]
                    score = np.where(some, np.round(score, 6), 0.0)
                else:
                    langs, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(score, pa.float64())], names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [F.col(f"`{text}`").alias("_q_text")])).mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = fraction(F.col("doc_id"), 3) == 1
    model = learned(docs.filter(~held))
    return identified(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held.alias("held_out"), F.col("_q_lang").alias("lang_pred"), F.col("_q_score").alias("score"))
