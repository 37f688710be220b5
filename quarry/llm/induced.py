"""Suffix sorting by external induced sorting: suffixes with their common prefixes, in bounded memory.

A suffix is of type S or L as it is smaller or larger than the one behind it; the leftmost S of each run is an anchor.

1. Types are found from the text's end to its start.  An anchor's name is the order of its symbols up to the symbol behind the run
   in which the next anchor stands, so names differ where symbols do; names are made by external sorts of a few symbols at a
   time, and the common prefix of neighbouring names is kept.
2. Names in text order are a text of at most half the length, which is sorted by recursion until one fits into memory.  The
   recursion gives common prefixes in names; they become common prefixes in symbols by two lookups and a range minimum.
3. Sorted anchors induce all L suffixes in one scan from the smallest symbol on, and these all S suffixes in a scan from the largest
   down.  A scan is a priority queue of tuples: position, first symbol, the symbols before it, the length of its run, and the least
   common prefix since the tuple that was sent to the same part of the queue before it.  Ranks come in increasing order, so the
   queue is first in, first out for each first symbol, and a range of symbols is put in order when it is served.  The
   common prefix of neighbours with one first symbol is one more than the least between the suffixes behind them.
4. In one symbol L come before S, and where they meet the shorter run is the common prefix.

Everything of the text's length is a log of ``external.py``: in memory while the store's bound allows, else on disk.  Common prefixes
are counted up to ``cap``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .external import Log, Minima, Queue, Sorter, Store, fetched, range_minima, zipped

SUFFIX = np.dtype([("p", "i8"), ("lcp", "u1")])
#: A tuple of the queues: position, symbols before it, first symbol, run, common prefix, symbols left in ``pre``.
TUPLE = np.dtype([("p", "i8"), ("pre", "u8"), ("c", "u4"), ("run", "u1"), ("lcp", "u1"), ("left", "u1")])
MANY = 255
#: Bytes of working memory that a symbol of a text takes that is sorted in memory.
IN_MEMORY = 64


# ---------------------------------------------------------------------------------------------- in memory


def refined(group: np.ndarray, order: np.ndarray, active: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Sorts the members at the places ``active`` of ``order`` by ``column`` inside their groups; gives the places still tied.

    ``group`` maps a member to the first place of its group, and is brought up to date.
    """
    members = order[active]
    g = group[members]
    by = np.argsort((g << 32) | (column + 1))
    members, g, column = members[by], g[by], column[by]
    order[active] = members
    fresh = np.ones(len(members), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (column[1:] != column[:-1])
    first = active[np.maximum.accumulate(np.where(fresh, np.arange(len(members)), 0))]
    group[members] = first
    alone = fresh & np.append(fresh[1:], True)
    return active[~alone]


def doubled(names: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``names`` in order, and their common prefixes: ranks by one name, then two, four and so on."""
    m = len(names)
    group, order = names.astype(np.int64), np.argsort(names, kind="stable")
    group_of_place = group[order]
    tied = np.zeros(m, bool)
    tied[1:] = group_of_place[1:] == group_of_place[:-1]
    tied[:-1] |= tied[1:]
    first = np.concatenate([[True], group_of_place[1:] != group_of_place[:-1]])
    group[order] = np.maximum.accumulate(np.where(first, np.arange(m), 0))
    active, k = np.flatnonzero(tied), 1
    while len(active):
        behind = order[active] + k
        active = refined(group, order, active, np.where(behind < m, group[np.minimum(behind, m - 1)], -1))
        k *= 2
    lcp = np.zeros(m, np.uint8)
    a, b = order[:-1], order[1:]
    live = np.flatnonzero(names[a] == names[b])
    for k in range(1, cap + 1):
        lcp[live + 1] = k
        x, y = a[live] + k, b[live] + k
        fits = (x < m) & (y < m)
        live, x, y = live[fits], x[fits], y[fits]
        live = live[names[x] == names[y]]
        if not len(live):
            break
    return order, np.minimum(lcp, cap)


# ---------------------------------------------------------------------------------------------- names


def anchors(store: Store, text: Log, n: int) -> Log:
    """(g = 0, p, len, run) of each anchor, from the last to the first: ``len`` symbols name it."""
    out = Log(store, [("g", "i8"), ("p", "i8"), ("len", "i8"), ("run", "u1")])
    end, later, later_s, run_end, name_end = n, -1, True, n, n
    for x in text.chunks(back=True):
        x = x.astype(np.int64)
        start = end - len(x)
        # the last position of all is S
        follows = np.append(x[1:], later) if end < n else np.append(x[1:], x[-1] + 1)
        differs = x != follows
        at = np.arange(len(x))
        change = np.minimum.accumulate(np.where(differs, at, len(x))[::-1])[::-1]
        up = follows > x
        s = np.where(change < len(x), up[np.minimum(change, len(x) - 1)], later_s)
        ends = np.where(change < len(x), start + change + 1, run_end)
        # an anchor at the start of the block behind is known now
        behind = np.append(s[1:], later_s if end < n else False)
        first = np.flatnonzero(~s & behind) + 1
        crossing = len(first) and first[-1] == len(x)
        if end == n and len(x) == n == 1:
            first = first[:0]
        p = first + start
        e = np.append(ends[first[:-1]], run_end) if crossing else ends[first]
        if len(p):
            # the next anchor's run ends a name, and one symbol behind it
            stop = np.append(e[1:], name_end)
            stop = np.minimum(np.where(np.arange(len(p)) == len(p) - 1, name_end, stop + 1), n)
            rows = np.zeros(len(p), out.dtype)
            rows["p"], rows["len"], rows["run"] = p, stop - p, np.minimum(e - p, MANY)
            out.append(rows[::-1].copy())
            name_end = min(int(e[0]) + 1, n)
        end, later, later_s, run_end = start, int(x[0]), bool(s[0]), int(ends[0])
    return out


def packed(text: Log, at: np.ndarray, length: np.ndarray, bits: int, each: int) -> np.ndarray:
    """``each`` symbols from ``at`` on as one number, 0 behind ``length``."""
    got = text.gather(at, each)
    out = np.zeros(len(at), np.uint64)
    for j in range(each):
        out = (out << np.uint64(bits)) | np.where(j < length, got[:, j], 0).astype(np.uint64)
    return out


def named(store: Store, text: Log, items: Log, cap: int, bits: int):
    """Names by text order (``g``: how many anchors have a smaller name), their places and runs, common prefixes by name, and ranges.

    Common prefixes of neighbouring names stand at the larger one's number, in a log of bytes that has ``MANY`` elsewhere.
    """
    each = 63 // bits
    m = items.rows
    by_place = Sorter(store, [("p", "i8"), ("g", "i8"), ("run", "u1")], "p")
    edges = Sorter(store, [("g", "i8"), ("lcp", "u1")], "g")
    active, k = items, 0
    while active.rows:
        column = Sorter(store, [("g", "i8"), ("p", "i8"), ("len", "i8"), ("run", "u1"), ("c", "u8")], "g", "c")
        for x in active.stream():
            y = np.empty(len(x), column.dtype)
            for f in x.dtype.names:
                y[f] = x[f]
            y["c"] = packed(text, x["p"] + k, x["len"] - k, bits, each)
            column.append(y)
        active.free()
        # the next round reads the text again in order of places, if it is not at hand
        active = Sorter(store, items.dtype, "p")
        at, was_g, was_c, g_at, c_at = 0, -1, 0, 0, 0
        for x in column.stream():
            g, c, i = x["g"], x["c"], np.arange(at, at + len(x))
            before_c = np.concatenate([[np.uint64(was_c)], c[:-1]])
            new_g = g != np.concatenate([[was_g], g[:-1]])
            new_c = new_g | (c != before_c)
            g_start = np.maximum.accumulate(np.where(new_g, i, g_at))
            c_start = np.maximum.accumulate(np.where(new_c, i, c_at))
            name = g + c_start - g_start
            split = np.flatnonzero(new_c & ~new_g)
            if len(split):
                e = np.empty(len(split), edges.dtype)
                same = np.zeros(len(split), np.int64)
                other = c[split] ^ before_c[split]
                for j in range(each):
                    same += other >> np.uint64(bits * (each - 1 - j)) == 0
                e["g"], e["lcp"] = name[split], np.minimum(k + same, cap)
                edges.append(e)
            over = x["len"] <= k + each
            done = np.empty(int(over.sum()), by_place.dtype)
            done["p"], done["g"], done["run"] = x["p"][over], name[over], x["run"][over]
            by_place.append(done)
            if not over.all():
                rest = np.empty(int((~over).sum()), items.dtype)
                rest["g"], rest["p"], rest["len"], rest["run"] = name[~over], x["p"][~over], x["len"][~over], x["run"][~over]
                active.append(rest)
            at, was_g, was_c, g_at, c_at = at + len(x), int(g[-1]), int(c[-1]), int(g_start[-1]), int(c_start[-1])
        k += each
    names, places, runs = Log(store, "i8"), Log(store, "i8"), Log(store, "u1")
    for x in by_place.stream():
        names.append(x["g"].copy())
        places.append(x["p"].copy())
        runs.append(x["run"].copy())
    prefix, groups, width = Log(store, "u1"), 1 + edges.rows, store.rows(TUPLE)
    starts, last, single = [0], 0, []
    filled = np.full(min(m, width), MANY, np.uint8)
    filled[0] = 0
    base = 0
    for x in edges.stream():
        g = x["g"]
        # a range of names ends where a block is full, before a name of more than a block and behind it
        before = np.concatenate([[last], g[:-1]])
        for b, a in zip(g[(g // width != before // width) | (g - before > width)].tolist(), before[(g // width != before // width) | (g - before > width)].tolist(), strict=True):
            if b - a > width and a != starts[-1]:
                starts.append(a)
            single.append(a == starts[-1])
            starts.append(b)
        last = int(g[-1])
        i = 0
        while i < len(g):
            while g[i] >= base + len(filled):
                prefix.append(filled)
                base += len(filled)
                filled = np.full(min(m - base, width), MANY, np.uint8)
            j = int(np.searchsorted(g, base + len(filled)))
            filled[g[i:j] - base] = x["lcp"][i:j]
            i = j
    while True:
        prefix.append(filled)
        base += len(filled)
        if base >= m:
            break
        filled = np.full(min(m - base, width), MANY, np.uint8)
    starts.append(m)
    return names, places, runs, prefix, groups, np.array(sorted(set(starts)), np.int64)


def recursion(store: Store, names: Log, groups: int, cap: int, starts: np.ndarray) -> tuple[Log, Log]:
    """(index of an anchor, common prefix in names) in the order of the anchors' suffixes."""
    index, common = Log(store, "i8"), Log(store, "u1")
    # names are two symbols apart at least
    cap = -(-cap // 2)
    if names.rows * IN_MEMORY <= store.memory or names.rows < 64:
        every = np.concatenate(list(names.chunks()))
        order, lcp = doubled(every, cap)
        index.append(order)
        common.append(lcp)
    elif groups == names.rows:
        rank = Sorter(store, [("g", "i8"), ("i", "i8")], "g")
        i = 0
        for x in names.chunks():
            y = np.empty(len(x), rank.dtype)
            y["g"], y["i"] = x, np.arange(i, i + len(x))
            rank.append(y)
            i += len(x)
        for y in rank.stream():
            index.append(y["i"].copy())
            common.append(np.zeros(len(y), np.uint8))
    else:
        for x in ordered(store, names, names.rows, cap, max(1, int(names.rows).bit_length()), starts):
            index.append(x["p"].copy())
            common.append(x["lcp"].copy())
    return index, common


def seeds(store: Store, text: Log, n: int, cap: int, bits: int) -> Log:
    """Tuples of all anchors in the order of their suffixes, with the common prefix of each and the one before it."""
    items = anchors(store, text, n)
    names, places, runs, prefix, groups, starts = named(store, text, items, cap, bits)
    index, common = recursion(store, names, groups, cap, starts)
    ahead, behind, was = Log(store, "i8"), Log(store, "i8"), 0
    # the first names that differ, of each suffix and of the one before it
    for i, d in zipped(index, common):
        ahead.append(i + d)
        before = np.concatenate([[was], i[:-1]]) + d
        behind.append(before)
        was = int(i[-1])
    p, run, p2 = fetched(store, places, index), fetched(store, runs, index), fetched(store, places, ahead)
    hi, lo = fetched(store, names, ahead), fetched(store, names, behind)
    for log in (names, places, runs, ahead, behind, index):
        log.free()
    # nothing is asked for the first of all, which has none before it, and for those that agree up to the cap
    fixed, first = Log(store, "i8"), True
    for a, b, d in zipped(lo, hi, common):
        a = np.where(d >= -(-cap // 2), b - 1, a)
        if first:
            a[0], first = b[0] - 1, False
        fixed.append(a)
    least = range_minima(store, prefix, fixed, hi)
    out, first = Log(store, TUPLE), True
    for q, r, q2, d, v in zipped(p, run, p2, common, least):
        x = np.zeros(len(q), TUPLE)
        x["p"], x["run"] = q, r
        x["lcp"] = np.where(d >= -(-cap // 2), cap, np.minimum(q2 - q + v, cap))
        if first:
            x["lcp"][0], first = 0, False
        out.append(refilled(text, x, bits, np.ones(len(x), bool)))
    for log in (p, run, p2, hi, lo, fixed, prefix, common, least):
        log.free()
    return out


def refilled(text: Log, x: np.ndarray, bits: int, own: np.ndarray) -> np.ndarray:
    """``x`` with the symbols before the tuples ``own`` in place."""
    each = 63 // bits
    q = x["p"][own]
    got = text.gather(q - each, each)
    pre = np.zeros(len(q), np.uint64)
    for j in range(each):
        pre |= got[:, each - 1 - j].astype(np.uint64) << np.uint64(bits * j)
    x["pre"][own], x["left"][own] = pre, np.minimum(each, q)
    return x


# ---------------------------------------------------------------------------------------------- induction


class Scan:
    """One scan: serves tuples in order and sends the suffixes before them on.

    ``up`` is the scan of L suffixes from the smallest symbol on; else symbols are counted from the largest down.
    """

    def __init__(self, store: Store, text: Log, starts: np.ndarray, cap: int, bits: int, up: bool):
        self.store, self.text, self.cap, self.bits, self.up = store, text, cap, bits, up
        self.top = int(starts[-1]) - 1
        #: first key of each range
        self.starts = starts if up else (self.top + 1 - starts)[::-1]
        self.queues = [Queue(store, TUPLE) for _ in range(len(self.starts) - 1)]
        #: the least common prefix since something was sent to a range
        self.low = np.full(len(self.queues), cap, np.uint8)
        self.mask = np.uint64((1 << bits) - 1)

    def key(self, c: np.ndarray) -> np.ndarray:
        c = c.astype(np.int64)
        return c if self.up else self.top - c

    def before(self, x: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(``x`` with symbols before it, their keys, whether the suffix before it is of the type that this scan induces)."""
        empty = (x["left"] == 0) & (x["p"] > 0)
        if empty.any():
            x = refilled(self.text, x.copy(), self.bits, empty)
        a = self.key(x["pre"] & self.mask)
        own = self.key(x["c"])
        return x, a, (x["p"] > 0) & np.where(seed, a > own, a >= own)

    def induced(self, x: np.ndarray, a: np.ndarray) -> np.ndarray:
        y = np.empty(len(x), TUPLE)
        y["p"], y["pre"], y["left"] = x["p"] - 1, x["pre"] >> np.uint64(self.bits), x["left"] - 1
        y["c"] = a if self.up else self.top - a
        same = y["c"] == x["c"]
        y["run"] = np.where(same, np.minimum(x["run"].astype(np.int64) + 1, MANY), 1)
        y["lcp"] = 0
        return y

    def send(self, x: np.ndarray, a: np.ndarray, goes: np.ndarray) -> None:
        """Sends the suffixes before the tuples ``goes`` of ``x``, a block in scan order, to their ranges."""
        lcp = x["lcp"]
        least = lcp.min()
        k = np.flatnonzero(goes)
        if not len(k):
            np.minimum(self.low, least, out=self.low)
            return
        to = np.searchsorted(self.starts, a[k], "right") - 1
        order = np.argsort(to.astype(np.uint16) if len(self.queues) < 1 << 16 else to, kind="stable")
        k, to = k[order], to[order]
        fresh = np.concatenate([[True], to[1:] != to[:-1]])
        since = np.where(fresh, -1, np.concatenate([[0], k[:-1]]))
        table = Minima(lcp)
        w = table.of(since + 1, k + 1)
        heads = np.flatnonzero(fresh)
        w[heads] = np.minimum(w[heads], self.low[to[heads]])
        y = self.induced(x[k], a[k])
        y["lcp"] = w
        tails = np.append(heads[1:], len(k)) - 1
        for q, i, j in zip(to[heads].tolist(), heads.tolist(), (tails + 1).tolist(), strict=True):
            self.queues[q].append(y[i:j].copy())
        np.minimum(self.low, least, out=self.low)
        behind = k[tails] + 1
        rest = np.full(len(tails), self.cap, np.uint8)
        some = behind < len(x)
        rest[some] = table.of(behind[some], np.full(int(some.sum()), len(x)))
        self.low[to[heads]] = rest

    def run(self, given: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        """Tuples of all induced suffixes in scan order, with the common prefix of each and the one served before it in its symbol
        (0 for a symbol's first); ``given`` are blocks of seeds in scan order, each with the common prefix with the seed before it."""
        self.seeds, self.held = given, None
        for r in range(len(self.queues)):
            end = int(self.starts[r + 1])
            if end - int(self.starts[r]) == 1 or self.queues[r].rows > 4 * self.store.rows(TUPLE):
                yield from self._one(r, end)
            else:
                yield from self._several(r, end)
            self.queues[r].free()

    def _given(self, end: int) -> Iterator[np.ndarray]:
        """The seeds with keys below ``end``, by blocks."""
        while True:
            if self.held is None or not len(self.held):
                self.held = next(self.seeds, None)
                if self.held is None:
                    return
            key = self.key(self.held["c"])
            n = int(np.searchsorted(key, end))
            if not n:
                return
            x, self.held = self.held[:n], self.held[n:]
            yield x

    def _one(self, r: int, end: int) -> Iterator[np.ndarray]:
        """A range of one symbol: its queue until it is empty, then its seeds."""
        first, run = True, 0
        while (x := self.queues[r].pop()) is not None:
            x = x.copy()
            x["lcp"] = np.minimum(x["lcp"].astype(np.int64) + 1, self.cap)
            if first:
                x["lcp"][0], first = 0, False
            run = int(x["run"][-1])
            x, a, goes = self.before(x, np.zeros(len(x), bool))
            self.send(x, a, goes)
            yield x
        head = True
        for x in self._given(end):
            x = x.copy()
            if head:
                x["lcp"][0], head = (0 if first else min(run, int(x["run"][0]), self.cap)), False
            x, a, goes = self.before(x, np.ones(len(x), bool))
            self.send(x, a, goes)

    def _several(self, r: int, end: int) -> Iterator[np.ndarray]:
        """A range of symbols that fits into memory: what its tuples send into the range itself is put in order with them."""
        start = int(self.starts[r])
        known = []
        while (x := self.queues[r].pop()) is not None:
            known.append(x)
        known = np.concatenate(known) if known else np.zeros(0, TUPLE)
        given = [x.copy() for x in self._given(end)]
        given = np.concatenate(given) if given else np.zeros(0, TUPLE)
        arrivals, tail = known["lcp"].copy(), self.low[r]
        n0, n1 = len(known), len(given)
        every = np.concatenate([known, given])
        kind = np.concatenate([np.zeros(n0, np.int64), np.ones(n1, np.int64)])
        source = np.full(n0 + n1, -1, np.int64)
        every, a, goes = self.before(every, kind == 1)
        lo = 0
        while True:
            inside = lo + np.flatnonzero(goes[lo:] & (a[lo:] < end))
            if not len(inside):
                break
            fresh, fa, fg = self.before(self.induced(every[inside], a[inside]), np.zeros(len(inside), bool))
            lo = len(every)
            every, a, goes = np.concatenate([every, fresh]), np.concatenate([a, fa]), np.concatenate([goes, fg])
            kind, source = np.concatenate([kind, np.zeros(len(inside), np.int64)]), np.concatenate([source, inside])
        if not len(every):
            return
        key = self.key(every["c"])
        # when a tuple was sent: known ones in the order in which they came, others as their sources are served
        when = np.arange(len(every))
        made = source >= 0
        rank = None
        while True:
            order = np.lexsort((when, kind, key))
            new = np.empty(len(every), np.int64)
            new[order] = np.arange(len(every))
            if rank is not None and (new == rank).all():
                break
            rank = new
            when = np.where(made, n0 + n1 + 1 + rank[np.maximum(source, 0)], np.arange(len(every)))
        every, a, goes, kind, key, source = every[order], a[order], goes[order], kind[order], key[order], source[order]
        made = source >= 0
        # a tuple's time: that of its arrival, or behind all arrivals that of its source's turn
        time = np.where(made, n0 + 1 + rank[np.maximum(source, 0)], np.concatenate([np.arange(n0 + n1), np.zeros(len(every) - n0 - n1, np.int64)])[order])
        first = np.concatenate([[True], key[1:] != key[:-1]])
        lcp = np.where(first, 0, self.cap)
        seed = kind == 1
        seam = ~first & seed & np.concatenate([[False], ~seed[:-1]])
        lcp = np.where(seed & ~first, every["lcp"], lcp)
        lcp = np.where(seam, np.minimum(np.minimum(every["run"], np.concatenate([every["run"][:1], every["run"][:-1]])), self.cap), lcp).astype(np.uint8)
        asked = np.flatnonzero(~seed & ~first)
        from_, to = time[asked - 1], time[asked]
        while True:
            line = np.concatenate([arrivals, [tail], lcp]).astype(np.uint8)
            got = np.minimum(Minima(line).of(from_ + 1, to + 1).astype(np.int64) + 1, self.cap) if len(asked) else lcp[:0]
            if (lcp[asked] == got).all():
                break
            lcp[asked] = got
        every["lcp"] = lcp
        self.send(every, a, goes & (a >= end))
        yield every[~seed]


def ordered(store: Store, text: Log, n: int, cap: int, bits: int, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of SUFFIX rows of ``text`` in order: position, and common prefix with the one before it.

    The last symbol must be the only 0; symbols are below ``starts[-1]``, and ``starts`` cuts them into ranges for the queues.
    """
    if n == 1:
        yield np.zeros(1, SUFFIX)
        return
    first = seeds(store, text, n, cap, bits)
    # the symbols at the anchors: what precedes is known, the own symbol is read with it
    begin = Log(store, "i8")
    for x in first.chunks():
        begin.append(x["p"].copy())
    own = fetched(store, text, begin)
    begin.free()
    anchored = Log(store, TUPLE)
    for x, c in zipped(first, own):
        x = x.copy()
        x["c"] = c
        anchored.append(x)
    first.free()
    own.free()
    large = Log(store, TUPLE)
    for x in Scan(store, text, starts, cap, bits, True).run(anchored.chunks()):
        large.append(x)
    anchored.free()

    def downward() -> Iterator[np.ndarray]:
        """L suffixes from the largest down, each with the common prefix with the one above it."""
        above = 0
        for x in large.chunks(back=True):
            x = x[::-1].copy()
            lcp = x["lcp"].copy()
            x["lcp"][1:] = lcp[:-1]
            x["lcp"][0] = above
            above = int(lcp[-1])
            yield x

    small = Log(store, TUPLE)
    for x in Scan(store, text, starts, cap, bits, False).run(downward()):
        small.append(x[::-1].copy())
    yield np.array([(n - 1, 0)], SUFFIX)
    yield from _merged(large, small, cap)
    large.free()
    small.free()


def _merged(large: Log, small: Log, cap: int) -> Iterator[np.ndarray]:
    """L and S suffixes as one order: by symbol, L before S.  An S suffix comes with the common prefix with the one above it."""

    def turned() -> Iterator[np.ndarray]:
        """S suffixes from the smallest on, each with the common prefix with the one below it; 0 for a symbol's first."""
        for i in range(len(small.parts))[::-1]:
            yield from _whole_part(small, i)

    streams = [large.chunks(), turned()]
    held = [np.zeros(0, TUPLE), np.zeros(0, TUPLE)]
    open_ = [True, True]
    last_c, last_l, last_run, up = -1, False, 0, 0
    while True:
        for i in (0, 1):
            if open_[i] and not len(held[i]):
                got = next(streams[i], None)
                open_[i] = got is not None
                held[i] = got if got is not None else held[i]
        ends = [(int(held[i]["c"][-1]), i) for i in (0, 1) if open_[i]]
        take = [len(held[0]), len(held[1])]
        if ends:
            c, of = min(ends)
            take = [int(np.searchsorted(held[0]["c"], c, "right")), int(np.searchsorted(held[1]["c"], c, "right" if of else "left"))]
        x = np.concatenate([held[0][: take[0]], held[1][: take[1]]])
        is_s = np.concatenate([np.zeros(take[0], bool), np.ones(take[1], bool)])
        held = [held[0][take[0] :], held[1][take[1] :]]
        if len(x):
            turn = x["c"].astype(np.uint64) * np.uint64(2) + is_s
            order = np.argsort(turn.astype(np.uint16) if turn.max() < 1 << 16 else turn, kind="stable")
            x, is_s = x[order], is_s[order]
            c = x["c"].astype(np.int64)
            fresh = c != np.concatenate([[last_c], c[:-1]])
            after_l = np.concatenate([[last_l], ~is_s[:-1]])
            runs = np.concatenate([[last_run], x["run"][:-1]])
            # an S suffix's common prefix stands at the one below it
            below = np.concatenate([[up], x["lcp"][:-1]])
            out = np.empty(len(x), SUFFIX)
            out["p"] = x["p"]
            out["lcp"] = np.where(fresh, 0, np.where(~is_s, x["lcp"], np.where(after_l, np.minimum(np.minimum(runs, x["run"]), cap), below)))
            last_c, last_l, last_run, up = int(c[-1]), bool(~is_s[-1]), int(x["run"][-1]), int(x["lcp"][-1])
            yield out
        elif not any(open_):
            return


def _whole_part(log: Log, i: int) -> Iterator[np.ndarray]:
    part, most = log.parts[i], log.store.rows(log.dtype)
    n = len(part) if isinstance(part, np.ndarray) else part[2]
    for lo in range(0, n, most):
        hi = min(n, lo + most)
        yield part[lo:hi] if isinstance(part, np.ndarray) else log.store.read(part, log.dtype, lo, hi)


def suffixes(store: Store, text: Log, symbols: int, cap: int) -> Iterator[np.ndarray]:
    """Blocks of SUFFIX rows of a text of few symbols, in order."""
    yield from ordered(store, text, text.rows, cap, max(1, (symbols - 1).bit_length()), np.arange(symbols + 1))
