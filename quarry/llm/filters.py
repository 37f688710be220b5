"""Filters of hashes that spare rows a shuffle: bitmaps sized by the number of hashes, two bits for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Bits for each hash, and of a filter at least and at most.
EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28
#: Where in a hash the second place begins.
SECOND = 30
#: Bits of a page, as which a filter comes to the driver.
PAGE = 1 << 15


def bits_for(count: int, most: int = MOST_BITS) -> int | None:
    """Bits of a filter of ``count`` hashes: a power of two of ``EACH`` a hash at least; None beyond ``most``."""
    bits = max(min(LEAST_BITS, most), 1 << max(0, EACH * count - 1).bit_length())
    return bits if bits <= most else None


def bitmap(hashes: DataFrame, h: str, bits: int) -> np.ndarray:
    """A bitmap of ``bits`` bits, set at two places of each hash; the driver gets its pages, bits / 8 bytes at most."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            at = np.sort(b.column(1).to_numpy())
            if not len(at):
                continue
            page = at // PAGE
            cuts = np.concatenate([[0], np.flatnonzero(page[1:] != page[:-1]) + 1, [len(at)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                to = own.setdefault(int(page[lo]), np.zeros(PAGE // 32, np.uint32))
                i = at[lo:hi] % PAGE
                np.bitwise_or.at(to, i >> 5, np.uint32(1) << (i & 31).astype(np.uint32))
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["page", "x"])

    places = F.array(F.pmod(F.col(h), F.lit(bits)), F.pmod(F.shiftright(F.col(h), SECOND), F.lit(bits)))
    at = hashes.select(F.explode(places).alias("at")).select((F.col("at") / PAGE).cast("long").alias("page"), "at")
    got = at.repartition(min(partitions(hashes.sparkSession), max(1, bits // PAGE)), "page").mapInArrow(pages, "page bigint, x binary").toArrow()
    out = np.zeros(max(bits, PAGE) // 32, np.uint32)
    for page, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        out[page * (PAGE // 32) : (page + 1) * (PAGE // 32)] = np.frombuffer(x, np.uint32)
    return out


class Filter:
    """Which hashes may be in a table; one that is ``open`` lets all through."""

    def __init__(self, shared=None, bits: int = 0):
        self.shared, self.bits, self.open = shared, bits, shared is None

    @classmethod
    def of(cls, hashes: DataFrame, h: str, most: int = MOST_BITS) -> Filter:
        """A filter for the column ``h``, open if more than ``most`` bits would be needed.  ``hashes`` is counted and read once."""
        bits = bits_for(hashes.count(), most)
        if bits is None:
            return cls()
        return cls(hashes.sparkSession.sparkContext.broadcast(bitmap(hashes, h, bits)), bits)

    def passes(self, h: np.ndarray) -> np.ndarray:
        if self.open:
            return np.ones(len(h), bool)
        found = np.ones(len(h), bool)
        for x in (h, h >> SECOND):
            at = x & (self.bits - 1)
            found &= (self.shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
        return found
