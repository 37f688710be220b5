"""Vectorised text scanning for Arrow batches: many texts in one byte buffer, words as arrays of offsets and hashes.

The functions here run inside ``mapInArrow``.  Batches are cut into blocks of at most ``BLOCK`` bytes of text (a longer text is
a block of its own), so memory follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
BLOCK = 1 << 19
_RNG = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, A-Z as a-z, and odd powers for positions in a word.
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_NOT_TOKEN = np.zeros(256, bool)
_NOT_TOKEN[:48] = _NOT_TOKEN[58:65] = _NOT_TOKEN[91:97] = _NOT_TOKEN[123:128] = True
SEPARATORS = {"word": _SPACE, "token": _NOT_TOKEN}


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows; a null text is empty.  ``offsets`` has one entry more than the block has rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:
        keep = np.diff(offs) * np.asarray(column.is_valid())
        if keep.sum() != offs[-1] - offs[0]:
            column = column.fill_null(b"")
            yield from blocks(column, most)
            return
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text where its words begin in these (one entry more than texts)."""
    n = len(data)
    gap = np.ones(n + 1, bool)
    gap[:n] = SEPARATORS[kind][data]
    first = ~gap[:n]
    first[1:] &= gap[: n - 1] if n else gap[:0]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = ~gap[cuts]  # a word doesn't go on into the next text
    last = ~gap[:n] & gap[1 : n + 1]
    last[cuts - 1] |= ~gap[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 256) - 1, _BASE, np.uint64))])
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z as a-z, the same wherever the word stands.

    Longer texts are hashed by runs of words of about a block, so that memory doesn't follow them.
    """
    if len(data) <= 2 * BLOCK or len(starts) < 2:
        return _word_hashes(data, starts, ends)
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        at = starts[i]
        out.append(_word_hashes(data[at : ends[j - 1]], starts[i:j] - at, ends[i:j] - at))
        i = j
    return np.concatenate(out)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    place = np.arange(len(data), dtype=np.int64)
    base = np.zeros(len(data), np.int64)
    base[starts[0] :] = np.repeat(starts, np.diff(np.append(starts, len(data))))
    place -= base
    np.minimum(place, int(lengths.max()), out=place)
    place[: starts[0]] = 0
    values = _VALUE[data] * powers(int(lengths.max()) + 1)[place]
    bounds = np.empty(2 * len(starts), np.int64)
    bounds[0::2], bounds[1::2] = starts, ends
    if bounds[-1] == len(data):
        sums = np.add.reduceat(values, bounds[:-1])[0::2]
    else:
        sums = np.add.reduceat(values, bounds)[0::2]
    return mix(sums ^ lengths.astype(np.uint64))


def hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0])


def fold(b: bytes) -> bytes:
    return _FOLD[np.frombuffer(b, np.uint8)].tobytes()
