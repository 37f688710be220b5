"""Brute-force versions of the training-data queries, written from their contracts."""

import collections
import hashlib
import re
import zlib

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def tokens(text):
    return TOKEN.findall((text or "").translate(LOWER))


def held_out(doc_id, mod):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % mod


def luhn(d):
    s = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        s += x - 9 * (x > 9)
    return s % 10 == 0


def base_spans(t):
    digits = lambda s: "".join(c for c in s if c in "0123456789")
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15],
    }


def personal(text):
    f = base_spans(text or "")
    joined = ",".join(f"{k}:{a}:{b}" for k in f for a, b in f[k])
    return (*(len(f[k]) for k in f), hashlib.sha256(joined.encode()).hexdigest(), joined)


def contamination(docs, bench, n=13):
    """docs: texts; bench: (item, text).  (n_words, n_hit, items) of each text."""
    grams = collections.defaultdict(set)
    for item, text in bench:
        w = tokens(text)
        for i in range(max(1, len(w) - n + 1) if w else 0):
            grams[tuple(w[i : i + n])].add("" if item is None else str(item))
    lengths = {len(g) for g in grams}
    out = []
    for text in docs:
        w = tokens(text)
        hit, items = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in grams:
                    hit.update(range(i, i + k))
                    items |= grams[g]
        out.append((len(w), len(hit), sorted(items)))
    return out


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(texts, k, percent):
    """(set size, group) of each text; groups are numbered by their first text."""
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def repeats(rows, length=100):
    """rows: (key, text) in order.  (n_bytes, n_removed, n_spans, kept) of each."""
    seen, out = set(), []
    for _, t in rows:
        x = (t or "").encode()
        n = len(x)
        cover = np.zeros(n + 1, np.int64)
        own = []
        for i in range(n - length + 1):
            w = x[i : i + length]
            if w in seen:
                cover[i] += 1
                cover[i + length] -= 1
            else:
                seen.add(w)
            own.append(w)
        gone = np.cumsum(cover)[:n] > 0
        spans = int((gone[1:] & ~gone[:-1]).sum() + (gone[0] if n else 0))
        out.append((n, int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return out


def targets(sizes):
    """Sources' targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    got = dict.fromkeys(order, 0.0)
    full = set()
    rest = float(sum(sizes.values()))
    while rest > 1e-9 and len(full) < len(order):
        w = sum(weight[s] for s in order if s not in full)
        share, rest = rest, 0.0
        for s in order:
            if s not in full:
                got[s] += share * weight[s] / w
        for s in order:
            if got[s] > 3 * sizes[s]:
                rest += got[s] - 3 * sizes[s]
                got[s] = 3.0 * sizes[s]
                full.add(s)
    return got
