"""Arrays larger than memory: logs, sorted streams and lookups that share one bound on memory and spill to one folder.

A :class:`Store` counts the bytes that its logs hold.  Above its ``memory`` the largest logs go to a file in its folder, which is
the shared folder of the cluster, reached through ``pyarrow.fs``; files go as soon as nothing in them is needed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs

#: Numbers of a page that a lookup reads at once.
PAGE = 1 << 14
#: Runs that are merged at once; more are merged in passes.
FAN = 24


class Store:
    """Memory that logs share, and the folder for what exceeds it."""

    def __init__(self, memory: int, folder: str):
        self.memory, self.folder = memory, folder
        self.held, self.spilled = 0, 0
        self.logs: dict[Log, None] = {}
        self.live: dict[str, int] = {}
        self.files = None

    def rows(self, dtype) -> int:
        """Rows of a block."""
        return max(64, self.memory // (6 * np.dtype(dtype).itemsize))

    def grow(self, n: int) -> None:
        self.held += n
        if self.held <= self.memory:
            return
        if self.files is None:
            self.files, self.path = fs.FileSystem.from_uri(self.folder)
            self.files.create_dir(self.path, recursive=True)
        name, at = f"{self.path}/{uuid.uuid4().hex}", 0
        with self.files.open_output_stream(name) as out:
            for log in sorted(self.logs, key=lambda x: x.bytes, reverse=True):
                if self.held <= self.memory // 2 or not log.bytes:
                    break
                held = log.bytes
                at = log.spill(out, name, at)
                self.held -= held
                self.spilled += held

    def read(self, part: tuple, dtype, lo: int, hi: int) -> np.ndarray:
        name, at, _ = part
        size = np.dtype(dtype).itemsize
        with self.files.open_input_file(name) as f:
            return np.frombuffer(f.read_at((hi - lo) * size, at + lo * size), dtype)

    def done(self, part) -> None:
        if isinstance(part, tuple):
            self.live[part[0]] -= 1
            if not self.live[part[0]]:
                del self.live[part[0]]
                self.files.delete_file(part[0])


class Log:
    """Rows in the order in which they were appended."""

    def __init__(self, store: Store, dtype):
        self.store, self.dtype = store, np.dtype(dtype)
        self.parts: list = []
        self.head, self.bytes, self.rows = 0, 0, 0
        store.logs[self] = None

    def append(self, x: np.ndarray) -> None:
        if len(x):
            self.parts.append(x)
            self.rows += len(x)
            self.bytes += x.nbytes
            self.store.grow(x.nbytes)

    def write(self, out, name: str, at: int, x: np.ndarray) -> tuple:
        out.write(x.tobytes())
        self.store.live[name] = self.store.live.get(name, 0) + 1
        return (name, at, len(x))

    def spill(self, out, name: str, at: int) -> int:
        """Writes what is in memory, part by part."""
        for i in range(self.head, len(self.parts)):
            if isinstance(x := self.parts[i], np.ndarray):
                self.parts[i] = self.write(out, name, at, x)
                at += x.nbytes
        self.bytes = 0
        return at

    def chunks(self, back: bool = False) -> Iterator[np.ndarray]:
        """Blocks in order, or from the last to the first (each in its own order)."""
        most = self.store.rows(self.dtype)
        for i in range(len(self.parts))[:: -1 if back else 1]:
            n = len(self.parts[i]) if isinstance(self.parts[i], np.ndarray) else self.parts[i][2]
            for lo in range(0, n, most)[:: -1 if back else 1]:
                part, hi = self.parts[i], min(n, lo + most)
                yield part[lo:hi] if isinstance(part, np.ndarray) else self.store.read(part, self.dtype, lo, hi)

    stream = chunks

    def array(self) -> np.ndarray | None:
        """All rows as one array, if none is on disk."""
        if any(isinstance(p, tuple) for p in self.parts):
            return None
        if len(self.parts) != 1:
            self.parts = [np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)]
        return self.parts[0]

    def gather(self, at: np.ndarray, width: int) -> np.ndarray:
        """Numbers ``at[i]`` to ``at[i] + width`` of a log of numbers, 0 outside; places on disk are read by pages, so sorted ``at`` is read once."""
        out = np.zeros((len(at), width), self.dtype)
        if (x := self.array()) is not None:
            for j in range(width):
                p = at + j
                ok = (p >= 0) & (p < len(x))
                out[:, j] = x[p] if ok.all() else np.where(ok, x[np.clip(p, 0, len(x) - 1)], 0)
            return out
        order = None if (at[1:] >= at[:-1]).all() else np.argsort(at, kind="stable")
        at = at if order is None else at[order]
        got = np.zeros_like(out)
        sizes = [len(p) if isinstance(p, np.ndarray) else p[2] for p in self.parts]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        # only parts that hold a number asked for
        lows, highs = np.searchsorted(at, starts[:-1] - width + 1), np.searchsorted(at, starts[1:])
        for i in np.flatnonzero(lows < highs).tolist():
            part, n, start, lo, hi = self.parts[i], sizes[i], int(starts[i]), int(lows[i]), int(highs[i])
            while lo < hi:
                first = max(0, int(at[lo]) - start)
                end = min(n, first + PAGE)
                page = part[first:end] if isinstance(part, np.ndarray) else self.store.read(part, self.dtype, first, end)
                to = int(np.searchsorted(at, start + first + max(1, end - first - width + 1))) if end < n else hi
                to = min(hi, max(to, lo + 1))
                for j in range(width):
                    p = at[lo:to] + j - start - first
                    ok = (p >= 0) & (p < end - first)
                    got[lo:to, j][ok] = page[p[ok]]
                lo = to
        if order is None:
            return got
        out[order] = got
        return out

    def free(self) -> None:
        for p in self.parts[self.head :]:
            self.store.done(p)
        self.store.held -= self.bytes
        self.bytes, self.parts, self.head = 0, [], 0
        self.store.logs.pop(self, None)


class Queue(Log):
    """A first-in-first-out log."""

    def spill(self, out, name: str, at: int) -> int:
        own = [i for i in range(self.head, len(self.parts)) if isinstance(self.parts[i], np.ndarray)]
        if own:
            # what is in memory always stands behind what is on disk, but for a rest of the block served last
            x = np.concatenate([self.parts[i] for i in own])
            if own[-1] - own[0] + 1 != len(own):
                return super().spill(out, name, at)
            self.parts[own[0] : own[-1] + 1] = [self.write(out, name, at, x)]
            at += x.nbytes
        self.bytes = 0
        return at

    def pop(self) -> np.ndarray | None:
        """The next rows, at most a block; None if there are none."""
        most, got, n = self.store.rows(self.dtype), [], 0
        while self.head < len(self.parts) and n < most:
            part = self.parts[self.head]
            if isinstance(part, tuple):
                if got:
                    break
                name, at, rows = part
                x = self.store.read(part, self.dtype, 0, min(rows, most))
                if rows > most:
                    self.parts[self.head] = (name, at + x.nbytes, rows - most)
                else:
                    self.store.done(part)
                    self.head += 1
                got, n = [x], len(x)
                break
            got.append(part)
            n += len(part)
            self.parts[self.head] = None
            self.head += 1
            self.bytes -= part.nbytes
            self.store.held -= part.nbytes
        if self.head > 64:
            del self.parts[: self.head]
            self.head = 0
        self.rows -= n
        return (got[0] if len(got) == 1 else np.concatenate(got)) if got else None


    def drained(self) -> Iterator[np.ndarray]:
        while (x := self.pop()) is not None:
            yield x
        self.free()


def by(x: np.ndarray, keys: tuple[str, ...]) -> np.ndarray:
    """``x`` in the order of its fields ``keys``; ties in any order."""
    columns = [np.ascontiguousarray(x[k]) for k in keys]
    if len(columns) > 1 and len(x) and (columns[0] == columns[0][0]).all():
        columns = columns[1:]
    return x[np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])]


class Sorter(Log):
    """Rows that come out in the order of ``keys``: sorted runs on disk, merged by blocks."""

    def __init__(self, store: Store, dtype, *keys: str):
        super().__init__(store, dtype)
        self.keys = keys

    def spill(self, out, name: str, at: int) -> int:
        own = [p for p in self.parts if isinstance(p, np.ndarray)]
        self.parts = [p for p in self.parts if isinstance(p, tuple)]
        if own:
            x = by(np.concatenate(own), self.keys)
            self.parts.append(self.write(out, name, at, x))
            at += x.nbytes
        self.bytes = 0
        return at

    def stream(self) -> Iterator[np.ndarray]:
        """All rows in order, once; the log is free afterwards."""
        self.store.logs.pop(self, None)
        spilled, own = [p for p in self.parts if isinstance(p, tuple)], [p for p in self.parts if isinstance(p, np.ndarray)]
        self.parts = []
        rest = by(np.concatenate(own), self.keys) if own else np.zeros(0, self.dtype)
        del own
        runs = [self._cut(rest), *(self._read(p) for p in spilled)]
        while len(runs) > FAN:
            longer = Queue(self.store, self.dtype)
            for x in self._merge(runs[:FAN]):
                longer.append(x)
            runs = [*runs[FAN:], longer.drained()]
        yield from self._merge(runs) if len(runs) > 1 else runs[0]
        self.store.held -= self.bytes
        self.bytes = 0

    def _cut(self, x: np.ndarray) -> Iterator[np.ndarray]:
        most = self.store.rows(self.dtype)
        for lo in range(0, len(x), most):
            yield x[lo : lo + most]

    def _read(self, part: tuple) -> Iterator[np.ndarray]:
        most = max(64, self.store.memory // (2 * FAN * self.dtype.itemsize))
        for lo in range(0, part[2], most):
            yield self.store.read(part, self.dtype, lo, min(part[2], lo + most))
        self.store.done(part)

    def _merge(self, runs: list) -> Iterator[np.ndarray]:
        held = {i: x for i, r in enumerate(runs) if (x := next(r, None)) is not None}
        ends = {i: self._key(x[-1]) for i, x in held.items()}
        heads = {i: self._key(x[0]) for i, x in held.items()}
        while held:
            # all rows up to the least of the blocks' ends are at hand
            bound = min(ends.values())
            out = []
            for i in [i for i, k in heads.items() if k <= bound]:
                x = held[i]
                n = len(x) if ends[i] <= bound else self._below(x, bound)
                out.append(x[:n])
                x = x[n:] if n < len(x) else next(runs[i], None)
                if x is None:
                    del held[i], ends[i], heads[i]
                else:
                    held[i], ends[i], heads[i] = x, self._key(x[-1]), self._key(x[0])
            if len(out) == 1:
                yield out[0]
                continue
            every, at = np.empty(sum(len(x) for x in out), self.dtype), 0
            for x in out:
                every[at : at + len(x)] = x
                at += len(x)
            yield by(every, self.keys)

    def _key(self, row: np.void) -> tuple:
        return tuple(row[k] for k in self.keys)

    def _below(self, x: np.ndarray, bound: tuple) -> int:
        """How many of the sorted rows are at or below ``bound``."""
        lo, hi = 0, len(x)
        for i, k in enumerate(self.keys):
            a = lo + int(np.searchsorted(x[k][lo:hi], bound[i], "left"))
            b = lo + int(np.searchsorted(x[k][lo:hi], bound[i], "right"))
            lo, hi = a, b
        return hi


def zipped(*logs: Log) -> Iterator[list[np.ndarray]]:
    """Aligned blocks of logs of equal length."""
    streams = [log.chunks() for log in logs]
    held = [np.zeros(0, log.dtype) for log in logs]
    while True:
        for i, s in enumerate(streams):
            if not len(held[i]):
                held[i] = next(s, held[i])
        n = min(len(x) for x in held)
        if not n:
            return
        yield [x[:n] for x in held]
        held = [x[n:] for x in held]


def fetched(store: Store, source: Log, at: Log) -> Log:
    """``source[i]`` for each ``i`` of ``at``, in its order: direct in memory, else by two sorts."""
    out = Log(store, source.dtype)
    if source.array() is not None:
        for x in at.chunks():
            out.append(source.gather(x, 1)[:, 0])
        return out
    asked, back, r = Sorter(store, [("i", "i8"), ("r", "i8")], "i"), Sorter(store, [("r", "i8"), ("v", source.dtype)], "r"), 0
    for x in at.chunks():
        q = np.empty(len(x), asked.dtype)
        q["i"], q["r"] = x, np.arange(r, r + len(x))
        r += len(x)
        asked.append(q)
    for q in asked.stream():
        v = np.empty(len(q), back.dtype)
        v["r"], v["v"] = q["r"], source.gather(q["i"], 1)[:, 0]
        back.append(v)
    for v in back.stream():
        out.append(v["v"].copy())
    return out


class Minima:
    """Range minima of an array in memory, by doubling."""

    def __init__(self, x: np.ndarray):
        self.levels = [x]
        w = 1
        while 2 * w <= len(x):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-w], last[w:]))
            w *= 2

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of [lo, hi); every range has an element."""
        width = (hi - lo).astype(np.int64)
        level = np.frexp(width.astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            own = level == k
            x = self.levels[k]
            out[own] = np.minimum(x[lo[own]], x[hi[own] - (1 << k)])
        return out


def range_minima(store: Store, d: Log, lo: Log, hi: Log) -> Log:
    """The least of ``d`` in (lo, hi] for each pair, in their order: by pages, sorted by one end and then by the other."""
    out = Log(store, d.dtype)
    x = d.array()
    if x is not None and x.nbytes * 24 <= store.memory // 2:
        table = Minima(x)
        for a, b in zipped(lo, hi):
            out.append(table.of(a + 1, b + 1))
        return out
    row = [("a", "i8"), ("b", "i8"), ("r", "i8"), ("v", d.dtype)]
    left, right, back, r = Sorter(store, row, "a"), Sorter(store, row, "b"), Sorter(store, row, "r"), 0
    for a, b in zipped(lo, hi):
        q = np.zeros(len(a), row)
        q["a"], q["b"], q["r"] = a + 1, b, np.arange(r, r + len(a))
        r += len(a)
        left.append(q)
    page = max(64, min(PAGE, store.memory // 64))
    pages = -(-d.rows // page)
    least = np.concatenate([[c.min()] for c in _paged(d, page)]) if pages else np.zeros(0, d.dtype)
    whole = Minima(least)
    for k, c, q in _at_pages(d, page, left, "a"):
        q, same = q.copy(), q["b"] // page == k
        if same.any():
            q["v"][same] = Minima(c).of(q["a"][same] - k * page, q["b"][same] + 1 - k * page)
        suffix = np.minimum.accumulate(c[::-1])[::-1]
        q["v"][~same] = suffix[q["a"][~same] - k * page]
        right.append(q)
    for k, c, q in _at_pages(d, page, right, "b"):
        q, far = q.copy(), q["a"] // page != k
        prefix = np.minimum.accumulate(c)
        q["v"][far] = np.minimum(q["v"][far], prefix[q["b"][far] - k * page])
        between = far & (q["a"] // page + 1 < k)
        if between.any():
            q["v"][between] = np.minimum(q["v"][between], whole.of(q["a"][between] // page + 1, np.full(int(between.sum()), k)))
        back.append(q)
    for q in back.stream():
        out.append(q["v"].copy())
    return out


def _paged(d: Log, page: int) -> Iterator[np.ndarray]:
    held = np.zeros(0, d.dtype)
    for x in d.chunks():
        held = np.concatenate([held, x])
        while len(held) >= page:
            yield held[:page]
            held = held[page:]
    if len(held):
        yield held


def _at_pages(d: Log, page: int, asked: Sorter, end: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(page number, page, the questions whose ``end`` lies in it)."""
    pages = enumerate(_paged(d, page))
    k, c = next(pages, (0, None))
    for q in asked.stream():
        of = q[end] // page
        cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(q)]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            while lo < hi and k < of[lo]:
                k, c = next(pages)
            if lo < hi:
                yield k, c, q[lo:hi]
