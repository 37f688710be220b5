"""Alignment of two tokenizers' tokens over a corpus.

A text, with a space before it, is encoded by a byte-level tokenizer (A) and by a piece tokenizer (B).  Byte offsets where tokens of both
end cut the tokens into groups; two occurrences are linked if their byte ranges overlap.  Between neighbouring offsets of the union of all
ends there is exactly one token of each side, so the links of a text are these gaps, and their number is ``n_a + n_b - n_groups``.

Corpus counts of linked id pairs: a pair is packed into one 64-bit number (``b * 2^32 + a``); ``np.unique`` sums them within a task, the
sums are sorted globally by ranges of that number, and runs of equal numbers are summed on the way into shards, two files of sorted
numbers and their counts.  The second pass over the texts maps the shards into memory and finds its pairs by ``searchsorted``.  No
pair table passes the driver: it gets a row for each shard and one count for each B id.

Texts are cut before a space that follows something else than white space: neither tokenizer has a token across that place
(A's expression begins a match there, B has no piece with its space mark behind another character, which is verified), so a word's
tokens are the same in every text.  Each task remembers the words that it has met, up to ``WORDS``, and encodes others in blocks.
If B has other pieces, whole texts are encoded.

Defined results: texts that are null, empty, or whose tokens' bytes are not the space and the text have no tokens: zeros, and an empty
digest.  Repeated rows count as often as they stand there; other columns are ignored; an empty table gives no rows.  Texts are encoded whole in
segments of ``SEGMENT`` characters; memory follows the longest run without a place to cut, and the different words of one text.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deleted, documents, dropped, partitions, released, scratch, written

#: Where the vocabulary files lie, on every machine, and their names.
TOKENIZERS = "/opt/tokenizers"
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a text that are cut into words at once, of new words that are encoded at once, and words that a task remembers.
SEGMENT, ENCODED, WORDS = 1 << 20, 1 << 18, 400_000
#: Characters of new words that B gets at once: its merges are a queue over all of them, which should fit the processor's cache.
PIECED = 1 << 14
#: Rows of an Arrow batch of pairs.
PAIRS = 100_000
MARK = "▁"
#: A space behind anything but white space (the Mongolian separator counts as such in older tables), and not at the end.
PLACE = re.compile(r"(?<=[^\s\u180e]) (?!\Z)")
#: A space behind white space; without any, and with none at either end, a text is cut at all its spaces.
ODD = re.compile(r"[\s\u180e] ")
#: Words for the faster encoder: ASCII and Latin letters with marks, which are the same in all versions of Unicode, not too long and without white space at the end.
LATIN = re.compile(r"[\x00-\x7f\u00c0-\u024f]{0,198}[\x21-\x7f\u00c0-\u024f]").fullmatch
#: Fixed value: A's expression, which its file names by its kind only.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOW = np.int64((1 << 32) - 1)
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """Letters of a byte-level vocabulary: printable bytes stand for themselves, all others for letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of each token."""

    def __init__(self, folder: str = TOKENIZERS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{BYTES}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{PIECES}")
        letters = byte_letters()
        tokens = json.loads(self.a.to_str())["model"]["vocab"]
        special = {x.content for x in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in tokens.items():
            self.a_bytes[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        #: The same vocabulary, whose ids are in the order of its merges, in a faster encoder.  Its letters may be of another Unicode version: for ``LATIN`` only.
        self.latin = tiktoken.Encoding("latin", pat_str=PATTERN, mergeable_ranks={self.a_bytes[i]: i for token, i in tokens.items() if token not in special}, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.cuts = not any(MARK in p.lstrip(MARK) for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i)))
        self.shown: dict[str, np.ndarray] = {}

    def shows(self, mark: str) -> np.ndarray:
        """Ids as text, each with ``mark`` behind it."""
        if mark not in self.shown:
            self.shown[mark] = np.array([f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object)
        return self.shown[mark]

    def encoded(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each word (none is empty) by A, behind a space, and by B, which sets its own."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        return a, self.b.encode(words, num_threads=1)

    def joined(self, words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and B and how many of them each word has, from one text of all words: spaces behind words are places to cut.

        None if the tokens' bytes aren't the text, or don't end with its words.
        """
        text = " ".join(words)
        want = (" " + text).encode()
        ends = np.cumsum([len(w) + 1 for w in words] if len(want) == len(text) + 1 else [len(w.encode()) + 1 for w in words])
        a = self.latin.encode_ordinary(" " + text) if plain else self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        out = []
        for ids, table, lengths in ((a, self.a_bytes, self.a_len), (self.pieced(words), self.b_bytes, self.b_len)):
            if b"".join(map(table.__getitem__, ids)) != want:
                return None
            ids = np.array(ids, np.int64)
            own = np.cumsum(lengths[ids])
            last = np.searchsorted(own, ends)
            if (own[last] != ends).any():
                return None
            out += [ids, np.diff(last, prepend=-1)]
        return tuple(out)

    def pieced(self, words: list[str]) -> list[int]:
        """Ids of B of a text of all words."""
        texts, at, size = [], 0, 0
        for i, w in enumerate(words, 1):
            size += len(w) + 1
            if size >= PIECED or i == len(words):
                texts.append(" ".join(words[at:i]))
                at, size = i, 0
        return list(chain.from_iterable(self.b.encode(texts, num_threads=1)))

    def segments(self, text: str) -> Iterator[list[str]]:
        """Words of a text, some at a time."""
        if not self.cuts:
            yield [text]
            return
        at = 0
        while len(text) - at > SEGMENT and (m := PLACE.search(text, at + SEGMENT)):
            yield cut(text[at : m.start()])
            at = m.end()
        yield cut(text[at:] if at else text)


def cut(text: str) -> list[str]:
    """A text, cut at each ``PLACE``."""
    return PLACE.split(text) if text[:1] == " " or text[-1:] == " " or ODD.search(text) else text.split(" ")


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each list has."""
    n = np.array([len(x) for x in ids], np.int64)
    return np.fromiter((i for x in ids for i in x), np.int64, int(n.sum())), n


class Aligned:
    """Token groups and links of many words at once; all arrays are in the order of ``words``, which is not that of the argument."""

    def __init__(self, t: Tokenizers, words: list[str], strings: bool):
        kinds: tuple[list[str], ...] = ([], [], [])
        for w in words:
            if t.cuts and LATIN(w):
                kinds[0].append(w)
            else:
                # the space behind a word is a place to cut if the word doesn't end with white space
                kinds[2 if not t.cuts or w[-1].isspace() or w[-1] == "\u180e" else 1].append(w)
        self.words, parts, ok = [], [], []
        for kind, own in enumerate(kinds):
            if not own:
                continue
            self.words += own
            if kind < 2 and (got := t.joined(own, kind == 0)):
                parts.append(got)
                ok += [True] * len(own)
                continue
            a, b = t.encoded(own)
            want = [(" " + w).encode() for w in own]
            good = [b"".join(map(t.a_bytes.__getitem__, x)) == w and b"".join(map(t.b_bytes.__getitem__, y)) == w for x, y, w in zip(a, b, want, strict=True)]
            parts.append((*flat([x if g else [] for x, g in zip(a, good, strict=True)]), *flat([x if g else [] for x, g in zip(b, good, strict=True)])))
            ok += good
        self.ok = np.array(ok, bool)
        self.a, self.n_a, self.b, self.n_b = (np.concatenate(x) for x in zip(*parts, strict=True))
        a_ends, b_ends = np.cumsum(t.a_len[self.a]), np.cumsum(t.b_len[self.b])
        ends = np.concatenate([[0], a_ends])[np.cumsum(self.n_a)]
        a_last, b_last = np.zeros(int(ends[-1]) + 1, bool), np.zeros(int(ends[-1]) + 1, bool)
        a_last[a_ends] = b_last[b_ends] = True
        both, either = np.flatnonzero(a_last & b_last), np.flatnonzero(a_last | b_last)
        self.keys = (self.b[np.searchsorted(b_ends, either)] << np.int64(32)) | self.a[np.searchsorted(a_ends, either)]
        self.n_links = np.diff(np.searchsorted(either, ends, "right"), prepend=0)
        self.n_groups = np.diff(np.searchsorted(both, ends, "right"), prepend=0)
        self.strings = self.listed(t, both, a_ends, b_ends, b_last[a_ends], a_last[b_ends]) if strings else []

    def listed(self, t: Tokenizers, both: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> list[str]:
        """``a1,a2|b1;`` for each group, joined for each word."""
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        a_in, b_in = np.bincount(a_group, minlength=len(both)), np.bincount(b_group, minlength=len(both))
        a_before, b_before = np.cumsum(a_in), np.cumsum(b_in)
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + (b_before - b_in)[a_group]] = np.where(a_last, t.shows("|")[self.a], t.shows(",")[self.a])
        out[np.arange(len(self.b)) + a_before[b_group]] = np.where(b_last, t.shows(";")[self.b], t.shows(",")[self.b])
        parts, cuts = out.tolist(), [0, *np.cumsum(self.n_a + self.n_b).tolist()]
        return ["".join(parts[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


class Words:
    """What a task knows of the words that it has met."""

    #: Per word: number of A and B tokens, groups and links, links with the best count, sum of counts.
    STATS = 6

    def __init__(self, tokenizers: Tokenizers, strings: bool = False, shards: Shards | None = None):
        self.tokenizers, self.want, self.shards = tokenizers, strings, shards
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.full = False
        self.strings: list[str] = []
        self.bad: set[int] = set()
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.table, self.counts = np.zeros((1024, self.STATS), np.int64), np.zeros(1024, np.int64)

    def add(self, words: list[str]) -> None:
        lo, size = 0, 0
        for i, w in enumerate(words):
            size += len(w)
            if size >= ENCODED or i == len(words) - 1:
                self._add(words[lo : i + 1])
                lo, size = i + 1, 0

    def _add(self, words: list[str]) -> None:
        x, at = Aligned(self.tokenizers, words, self.want), len(self.index)
        self.index.update(zip(x.words, range(at, at + len(words)), strict=True))
        if (n := len(self.index)) > len(self.table):
            more = max(n, 2 * len(self.table)) - len(self.table)
            self.table = np.concatenate([self.table, np.zeros((more, self.STATS), np.int64)])
            self.counts = np.concatenate([self.counts, np.zeros(more, np.int64)])
        self.bad.update((np.flatnonzero(~x.ok) + at).tolist())
        self.strings += x.strings
        rows = self.table[at:n]
        rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3] = x.n_a, x.n_b, x.n_groups, x.n_links
        if self.shards is None:
            self.parts.append((x.keys, x.n_links))
        else:
            found = self.shards.counts(x.keys)
            best = found == self.shards.best[x.keys >> np.int64(32)]
            cuts = np.concatenate([[0], np.cumsum(x.n_links)])
            for column, values in ((4, best.astype(np.int64)), (5, found)):
                rows[:, column] = np.diff(np.concatenate([[0], np.cumsum(values)])[cuts])

    def of(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, of which new ones are encoded first."""
        index = self.index
        if new := dict.fromkeys(filterfalse(index.__contains__, words)):
            self.add(list(new))
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Different packed pairs and their counts, by the counts of words."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, links = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        times = np.repeat(self.counts[: len(links)], links)
        keys, times = keys[times > 0], times[times > 0]
        order = np.argsort(keys, kind="stable")
        unique, first = np.unique(keys[order], return_index=True)
        return unique, np.add.reduceat(times[order], first) if len(unique) else times


def blocks(batch: pa.RecordBatch, column: int, t: Tokenizers) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Words of whole texts of up to ``SEGMENT`` characters together, with the texts' rows; a longer text comes as (row, none), to be cut into segments."""
    rows, parts, size = [], [], 0
    for i, x in enumerate(batch.column(column)):
        text = x.as_py() or ""
        if len(text) > SEGMENT:
            yield [i], []
        elif text:
            rows.append(i)
            parts.append(next(t.segments(text)))
            size += len(text)
            if size > SEGMENT:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def numbered(words: Words, batch: pa.RecordBatch, column: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(rows, numbers of their words, where each row's words begin) of good texts; the words of one row may come in several parts, if it is alone."""
    t = words.tokenizers
    for rows, parts in blocks(batch, column, t):
        if not parts:
            text = batch.column(column)[rows[0]].as_py()
            own = [words.of(p) for p in t.segments(text)]
            # taken only when the whole text is known to be good
            if not words.bad or not any(words.bad.intersection(x.tolist()) for x in own):
                for x in own:
                    yield rows, x, np.zeros(1, np.int64)
            continue
        x = words.of([w for p in parts for w in p])
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        if words.bad:
            wrong = np.isin(x, list(words.bad))
            if wrong.any():
                good = np.add.reduceat(wrong, starts[:-1]) == 0
                sizes = np.diff(starts)
                x, rows = x[np.repeat(good, sizes)], [r for r, g in zip(rows, good.tolist(), strict=True) if g]
                starts = np.concatenate([[0], np.cumsum(sizes[good])])
        if rows:
            yield rows, x, starts[:-1]


def partial_counts(folder: str, most: int):
    """(key, n) of the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Tokenizers(folder))

        def out():
            keys, n = words.pairs()
            for i in range(0, len(keys), PAIRS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + PAIRS]), pa.array(n[i : i + PAIRS])], ["key", "n"])
            words.clear()

        for b in batches:
            for _, x, _ in numbered(words, b, 0):
                words.counts += np.bincount(x, minlength=len(words.counts))
                words.full |= len(words.index) > most
            if words.full:
                yield from out()
        yield from out()

    return run


def shard_files(folder: str, vocabulary: int):
    """Writes sorted (key, n) rows, with equal keys summed, into a shard; yields its (path, lo, hi, n), and (b, top) of each B id in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        # the name is the task's attempt's own; only what a committed row names is read
        path = f"{root}/{os.urandom(16).hex()}"
        top, held, total, lo = np.zeros(vocabulary, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0, None
        keys_file = files.open_output_stream(f"{path}.keys", compression=None)
        counts_file = files.open_output_stream(f"{path}.counts", compression=None)

        def put(keys, counts):
            nonlocal total, lo
            if len(keys):
                keys_file.write(keys.tobytes())
                counts_file.write(counts.tobytes())
                np.maximum.at(top, keys >> np.int64(32), counts)
                lo = int(keys[0]) if lo is None else lo
                total += len(keys)

        for b in batches:
            if not b.num_rows:
                continue
            keys, n = (np.concatenate([x, b.column(i).to_numpy()]) for i, x in enumerate(held))
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, n = keys[first], np.add.reduceat(n, first)
            put(keys[:-1], n[:-1])
            held = keys[-1:], n[-1:]  # the next batch may go on with it
        put(*held)
        keys_file.close()
        counts_file.close()
        if total:
            b = np.flatnonzero(top)
            none = [None] * len(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path, *none], pa.string()), pa.array([lo, *none], pa.int64()), pa.array([int(held[0][0]), *none], pa.int64()), pa.array([total, *none], pa.int64()), pa.array([None, *b.tolist()], pa.int64()), pa.array([None, *top[b].tolist()], pa.int64())],
                ["path", "lo", "hi", "n", "b", "top"],
            )

    return run


class Shards:
    """Sorted counts on disk, mapped into memory when they are first needed."""

    def __init__(self, folder: str, listed: list[tuple[str, int, int]], best: np.ndarray):
        self.folder, self.best = folder, best
        self.paths, self.lo, self.n = [x[0] for x in listed], np.array([x[1] for x in listed], np.int64), [x[2] for x in listed]
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __reduce__(self):
        return Shards, (self.folder, list(zip(self.paths, self.lo.tolist(), self.n, strict=True)), self.best)

    def mapped(self, path: str) -> np.ndarray:
        files, _ = fs.FileSystem.from_uri(self.folder)
        if isinstance(files, fs.LocalFileSystem):
            with open(path, "rb") as f:
                return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.int64)
        # a store that can't be mapped: a nameless copy, which goes with the task
        with tempfile.TemporaryFile() as own, files.open_input_stream(path, compression=None) as source:
            shutil.copyfileobj(source, own, 1 << 20)
            own.flush()
            return np.frombuffer(mmap.mmap(own.fileno(), 0, access=mmap.ACCESS_READ), np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        unique, back = np.unique(keys, return_inverse=True)
        out = np.zeros(len(unique), np.int64)
        of = np.searchsorted(self.lo, unique, "right") - 1
        for i in np.unique(of).tolist():
            if i not in self.maps:
                self.maps[i] = self.mapped(f"{self.paths[i]}.keys"), self.mapped(f"{self.paths[i]}.counts")
            known, n = self.maps[i]
            mine = of == i
            at = np.minimum(np.searchsorted(known, unique[mine]), len(known) - 1)
            if (known[at] != unique[mine]).any():
                raise ValueError("a pair was not counted: the texts have changed between the passes")
            out[mine] = n[at]
        return out[back]


def pair_counts(docs: DataFrame, folder: str, text: str = "text", tokenizers: str = TOKENIZERS, most: int = WORDS) -> DataFrame:
    """Counts of all linked id pairs of the texts in sorted shards under ``folder``; the table of their files, and of B ids' highest counts."""
    spark = docs.sparkSession
    sums = written(docs.select(f"`{text}`").mapInArrow(partial_counts(tokenizers, most), "key bigint, n bigint"), "token-pairs")
    vocabulary = len(Tokenizers(tokenizers).b_bytes)
    dealt = sums.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key")
    out = written(dealt.mapInArrow(shard_files(folder, vocabulary), "path string, lo bigint, hi bigint, n bigint, b bigint, top bigint"), "token-shards")
    dropped(sums)
    return out


def shards(files: DataFrame, folder: str, tokenizers: str = TOKENIZERS) -> Shards:
    """The shards of :func:`pair_counts`: the driver holds a row for each, and a number for each B id."""
    best = np.zeros(len(Tokenizers(tokenizers).b_bytes), np.int64)
    for r in files.filter(F.col("b").isNotNull()).groupBy("b").agg(F.max("top").alias("top")).collect():
        best[r.b] = r.top
    listed = [(r.path, r.lo, r.n) for r in files.filter(F.col("path").isNotNull()).orderBy("lo").collect()]
    return Shards(folder, listed, best)


def pair_table(files: DataFrame, folder: str) -> DataFrame:
    """(a_id, b_id, n) of all linked pairs, read from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, lo, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = Shards(folder, [(path, lo, n)], np.zeros(0, np.int64))
                keys, counts = s.mapped(f"{path}.keys"), s.mapped(f"{path}.counts")
                for i in range(0, len(keys), PAIRS):
                    k = keys[i : i + PAIRS]
                    yield pa.RecordBatch.from_arrays([pa.array(k & LOW), pa.array(k >> np.int64(32)), pa.array(counts[i : i + PAIRS])], ["a_id", "b_id", "n"])

    rows = files.filter(F.col("path").isNotNull()).select("path", "lo", "n")
    return rows.repartition(partitions(files.sparkSession), "path").mapInArrow(run, "a_id bigint, b_id bigint, n bigint")


def aligned(docs: DataFrame, known: Shards, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, most: int = WORDS) -> DataFrame:
    """A row of SCHEMA for each row of ``docs``, from its tokens and the counts in ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Tokenizers(tokenizers), strings=True, shards=known)
        for b in batches:
            stats, digests, of, sha = np.zeros((b.num_rows, Words.STATS), np.int64), [""] * b.num_rows, None, None
            for rows, x, starts in numbered(words, b, 1):
                stats[rows] += np.add.reduceat(words.table[x], starts, axis=0)
                strings, cuts = list(map(words.strings.__getitem__, x.tolist())), [*starts.tolist(), len(x)]
                for row, lo, hi in zip(rows, cuts[:-1], cuts[1:], strict=True):
                    line = "".join(strings[lo:hi])[:-1]  # no mark behind the last group
                    if row == of:  # a long text's next part
                        sha.update(b";" + line.encode())
                    else:
                        of, sha = row, hashlib.sha256(line.encode())
                    digests[row] = sha.hexdigest()
            if len(words.index) > most:
                words.clear()
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(stats[:, c]) for c in range(Words.STATS)), pa.array(digests, pa.string())], COLUMNS)

    return docs.select(f"`{key}`", f"`{text}`").mapInArrow(run, SCHEMA)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = documents(spark, sf_dir), scratch(spark, "token-counts")
    files = pair_counts(docs, folder)
    out = written(aligned(docs, shards(files, folder)), "token-alignment")
    dropped(files)
    deleted(spark, folder)
    released(spark)
    return out
