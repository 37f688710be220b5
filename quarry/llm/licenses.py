"""License scans with a positional rare-token index.

Templates are licence texts and headers, and short phrases.  A word's IDF is over the templates.  The index holds postings (word:
template, position) of each template's rarest words only, so the words of a file that it holds are the file's licence words of
highest IDF.  These are looked up; a posting's place in the file less its place in the template is the place at which the template
would begin, and postings of a template intersect where these agree.

* A phrase needs all its rarest words to agree exactly; it is found if then every word of it stands in its place.
* A text may have been edited, so starts may drift by ``SLACK`` words from one posting to the next; ``NEED`` of its ``RARE`` rarest
  words must meet so.  Then all its words are held against the file at the starts that were voted for: it is found if words of
  ``SHARE`` of its IDF stand in place, and if its mandatory phrases stand there too, word by word.

Base phrases are templates like the others; their places make the base columns.  The other templates add labels.  The score is the
largest share of a template's IDF that the file holds in place; a template that isn't found, as a phrase or for want of a mandatory one,
counts half.

Defined results: a null or empty text has no words, no places, null first and last word, empty labels and score 0; repeated rows
are scanned one by one; other columns may stand beside key and text and are ignored.  A text is worked on whole; memory
follows the longest text's words, and starts are verified in parts of fixed size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import scan
from .common import LOWER, UPPER, documents
from .license_texts import BASE, MORE, TEXTS

#: Rarest words of a text and of a phrase that are indexed, and how many of a text's must meet.
RARE, RARE_IN_PHRASE, NEED = 12, 3, 4
#: Words by which starts may drift, and the least share of a text's IDF.
SLACK, SHARE = 12, 0.8
#: Words that are looked up, and template words that are held against a file, at a time.
AT_ONCE = 1 << 18
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


@dataclass
class Template:
    words: list[str]
    label: str
    base: bool
    phrase: bool
    keys: list[list[str]]
    #: (word, place) of all occurrences of the rarest words; how many different ones must meet; drift between them
    rare: list[tuple[str, int]] = None
    need: int = 0
    slack: int = 0
    total: float = 0.0


class Index:
    """Postings of rare words, and templates as flat arrays."""

    def __init__(self, base: dict[str, str] = BASE, more: dict[str, str] = MORE, texts: tuple = TEXTS):
        self.templates = [Template(words_of(p), label, i < len(base), True, []) for i, (p, label) in enumerate([*base.items(), *more.items()])]
        self.templates += [Template(words_of(t), label, False, False, [words_of(k) for k in keys]) for label, t, keys in texts]
        df = Counter(w for t in self.templates for w in set(t.words))
        # multiples of 2**-20 add up to the same sum in any order
        self.idf = {w: round(float(np.log(1 + len(self.templates) / n)) * (1 << 20)) / (1 << 20) for w, n in df.items()}
        for t in self.templates:
            t.total = sum(self.idf[w] for w in t.words)
            order = sorted(set(t.words), key=lambda w: (-self.idf[w], t.words.index(w)))[: RARE_IN_PHRASE if t.phrase else RARE]
            t.rare = [(w, k) for k, w in enumerate(t.words) if w in order]
            t.need, t.slack = (len(order), 0) if t.phrase else (min(NEED, len(order)), SLACK)
        vocabulary = sorted({w for t in self.templates for w in t.words})
        hashes = np.array([scan.hash_of(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.words = hashes[order], [vocabulary[i] for i in order]
        ids = {w: i for i, w in enumerate(self.words)}
        self.sizes = np.array([len(w) for w in self.words])
        self.letters = np.zeros((len(self.words), self.sizes.max()), np.uint8)
        for i, w in enumerate(self.words):
            self.letters[i, : len(w)] = np.frombuffer(w.encode(), np.uint8)
        self.weight = np.array([self.idf[w] for w in self.words])
        # postings by word: template, place, which of the template's rare words
        postings = sorted((ids[w], t, k) for t, x in enumerate(self.templates) for w, k in x.rare)
        self.post = np.array(postings, np.int64).reshape(-1, 3)
        self.post_at = np.searchsorted(self.post[:, 0], np.arange(len(self.words) + 1))
        self.flat = np.array([ids[w] for t in self.templates for w in t.words], np.int64)
        self.width = np.array([len(t.words) for t in self.templates])
        self.begin = np.concatenate([[0], np.cumsum(self.width)])
        self.need, self.slack = np.array([t.need for t in self.templates]), np.array([t.slack for t in self.templates])
        self.total, self.phrase = np.array([t.total for t in self.templates]), np.array([t.phrase for t in self.templates])
        self.keys = [[np.array([ids[w] for w in k]) for k in t.keys] for t in self.templates]

    def known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The index's number of each word, -1 for others.  The hash names the word; its bytes prove it."""
        out = np.full(len(starts), -1, np.int32)
        for lo in range(0, len(starts), AT_ONCE):
            out[lo : lo + AT_ONCE] = self._known(data, starts[lo : lo + AT_ONCE], ends[lo : lo + AT_ONCE])
        return out

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.full(len(starts), -1, np.int32)
        h = scan.word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        here = np.flatnonzero((self.hashes[at] == h) & (ends - starts == self.sizes[at]))
        for n in np.unique(self.sizes[at[here]]).tolist():
            own = here[self.sizes[at[here]] == n]
            same = (scan._FOLD[data[starts[own][:, None] + np.arange(n)]] == self.letters[at[own], :n]).all(1)
            out[own[same]] = at[own[same]]
        return out

    def find(self, word: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, template, first start, last start, share, found) of each place where a template's rare words meet.

        ``word`` are the index's numbers of the words of texts that begin at ``bounds``.
        """
        p = np.flatnonzero(word >= 0)
        counts = np.diff(self.post_at)[word[p]]
        p, counts = p[counts > 0], counts[counts > 0]
        if not len(p):
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0), np.zeros(0, bool))
        at = np.arange(counts.sum()) + np.repeat(self.post_at[word[p]] - (np.cumsum(counts) - counts), counts)
        p = np.repeat(p, counts)
        rare, t, k = self.post[at].T
        start, text = p - k, np.searchsorted(bounds, p, "right") - 1
        order = np.lexsort((start, t, text))
        rare, t, start, text = rare[order], t[order], start[order], text[order]
        # starts that drift by no more than the slack are one place
        fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (t[1:] != t[:-1]) | (start[1:] - start[:-1] > self.slack[t[1:]])])
        place = np.cumsum(fresh) - 1
        different = np.unique(place * len(self.words) + rare) // len(self.words)
        met = np.bincount(different, minlength=place[-1] + 1) >= self.need[t[fresh]]
        # each start once
        one = np.flatnonzero(met[place] & np.concatenate([[True], (place[1:] != place[:-1]) | (start[1:] != start[:-1])]))
        t, start, text, place = t[one], start[one], text[one], place[one]
        if not len(t):
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0), np.zeros(0, bool))
        _, place = np.unique(place, return_inverse=True)
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        share = self._stood(word, bounds, t, start, text, place, len(heads))
        t, text, first = t[heads], text[heads], start[heads]
        last = start[np.append(heads[1:], len(start)) - 1]
        share /= self.total[t]
        found = np.where(self.phrase[t], share == 1, share >= SHARE)
        for i in np.flatnonzero(found & ~self.phrase[t]).tolist():
            lo, hi = max(int(bounds[text[i]]), int(first[i]) - SLACK), min(int(bounds[text[i] + 1]), int(last[i] + self.width[t[i]]) + SLACK)
            found[i] = all(self._stands(word[lo:hi], key) for key in self.keys[t[i]])
        return text, t, first, last, share, found

    def _stood(self, word, bounds, t, start, text, place, places: int) -> np.ndarray:
        """IDF of the templates' words that stand in their place at some start of each place, from ``AT_ONCE`` words at a time."""
        widest = int(self.width.max())
        width = self.width[t]
        part = (np.cumsum(width) - 1) // AT_ONCE
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(t)]
        stood, open_ = np.zeros(places), np.zeros(0, np.int64)
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            n = width[lo:hi]
            of = np.repeat(np.arange(lo, hi), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q = start[of] + k
            inside = (q >= bounds[text[of]]) & (q < bounds[text[of] + 1])
            right = inside & (word[np.clip(q, 0, len(word) - 1)] == self.flat[self.begin[t[of]] + k])
            stands = np.unique(np.concatenate([open_, (place[of] * widest + k)[right]]))
            # the last place may go on in the next part: its words, a template's at most, wait for it
            own = stands // widest
            goes_on = own == place[hi - 1] if hi < len(t) else np.zeros(len(own), bool)
            open_, stands, own = stands[goes_on], stands[~goes_on], own[~goes_on]
            template = t[np.searchsorted(place, own)]
            stood += np.bincount(own, weights=self.weight[self.flat[self.begin[template] + stands % widest]], minlength=places)
        return stood

    @staticmethod
    def _stands(word: np.ndarray, key: np.ndarray) -> bool:
        n = len(word) - len(key) + 1
        return n > 0 and bool(np.logical_and.reduce([word[j : j + n] == w for j, w in enumerate(key.tolist())]).any())


@lru_cache(maxsize=1)
def index() -> Index:
    """The index of the given licences, one a Python worker."""
    return Index()


def scanned(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text) to batches of SCHEMA."""
    for batch in batches:
        for at, data, offsets in scan.blocks(batch.column(1)):
            n = len(offsets) - 1
            starts, ends, bounds = scan.words(data, offsets, "token")
            n_base, first, last, score = np.zeros(n, np.int64), [None] * n, [None] * n, np.zeros(n)
            base, labels = [set() for _ in range(n)], [set() for _ in range(n)]
            for o, t, start, _, share, found in zip(*(x.tolist() for x in index.find(index.known(data, starts, ends), bounds)), strict=True):
                template = index.templates[t]
                # a share that doesn't make a find stays below that of one
                score[o] = max(score[o], share if found else 0.5 * share)
                if found:
                    labels[o].add(template.label)
                    if template.base:
                        place = start - int(bounds[o])
                        base[o].add(template.label)
                        n_base[o] += 1
                        first[o] = place if first[o] is None else min(first[o], place)
                        last[o] = place if last[o] is None else max(last[o], place)
            join = lambda sets: [",".join(sorted(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n).cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(join(base)), pa.array(join(labels)), pa.array(np.round(score, 6))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )


def license_scan(docs: DataFrame, licences: tuple | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row of SCHEMA for each row of ``docs``; one narrow pass, no shuffle.  Words are counted from 0.

    ``licences`` are (base phrases, further phrases, texts) in the form of ``license_texts.py``, whose own are the default.
    """

    def run(batches):
        yield from scanned(batches, index() if licences is None else Index(*licences))

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, SCHEMA)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
