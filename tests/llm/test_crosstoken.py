"""Token alignment against whole texts, encoded at once and compared token by token."""

import collections
import hashlib
import random

import numpy as np
import pytest

from quarry.llm import crosstoken, registry
from quarry.llm.common import documents

T = crosstoken.Tokenizers()


def whole(text):
    """(A ids, B ids) of a text, or None."""
    if not text:
        return None
    a, b = T.a.encode(" " + text, add_special_tokens=False).ids, T.b.encode(text)
    want = (" " + text).encode()
    return (a, b) if b"".join(T.a_bytes[i] for i in a) == want and b"".join(T.b_bytes[i] for i in b) == want else None


def ranges(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i])))
        at += len(table[i])
    return out


def linked(a, b):
    x, y = ranges(a, T.a_bytes), ranges(b, T.b_bytes)
    out, lo = [], 0
    for i, (s, e) in enumerate(x):
        while y[lo][1] <= s:
            lo += 1
        j = lo
        while j < len(y) and y[j][0] < e:
            out.append((a[i], b[j]))
            j += 1
    return out


def groups(a, b):
    x, y = ranges(a, T.a_bytes), ranges(b, T.b_bytes)
    both = sorted({e for _, e in x} & {e for _, e in y})
    at, parts = 0, []
    for e in both:
        parts.append(",".join(str(i) for i, (s, f) in zip(a, x) if at <= s and f <= e) + "|" + ",".join(str(i) for i, (s, f) in zip(b, y) if at <= s and f <= e))
        at = e
    return parts


def wanted(rows):
    own = [(i, whole(t)) for i, t in rows]
    counts = collections.Counter(p for _, x in own if x for p in linked(*x))
    best = collections.defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for i, x in own:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = linked(*x)
        g = groups(*x) if len(x[0]) < 5_000 else None
        digest = hashlib.sha256(";".join(g).encode()).hexdigest() if g is not None else None
        out.append((i, len(x[0]), len(x[1]), len(g) if g is not None else None, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out, counts


def same(got, want):
    """Of very long texts, groups are compared by the other columns only."""
    long = {w[:3] for w in want if w[3] is None}
    cut = lambda r: (*r[:3], None, *r[4:7], None) if tuple(r[:3]) in long else tuple(r)
    assert collections.Counter(map(cut, got)) == collections.Counter(want)


def test_query(spark, tables, rows):
    got = [tuple(r) for r in registry.QUERIES["op13_token_alignment"](spark, tables).collect()]
    want, _ = wanted([(i, t) for i, t, *_ in rows])
    same(got, want)
    assert sum(w[1] > 0 for w in want) > 15


def test_empty_table(spark, empty):
    got = registry.QUERIES["op13_token_alignment"](spark, empty)
    assert got.columns == crosstoken.COLUMNS and got.count() == 0


ODD = [
    " ", "  ", "   ", " a", "a ", "a  ", "a  b", "a   b ", "\n a", "a \n b", "a\n b", "\t", "don't we'll I'M", "<|endoftext|> <s> </s> <unk> <0x41>", "x▁y", "▁", "é é", "　wide　 space", "\x00 \x01", "a\x85 b\xa0 c\x1c d", "᠎ a᠎ b",
    "\U0001f600 \U0001f468‍\U0001f469", "ﬁ ａ Ⅷ", "a" * 3000, "12345 678 9", "...!!! ???", "日本語 テキスト", "é ́ x", "​ ​", "﻿ a", "a  b", "- -  -   -", "'s 't",
]


def test_cut_texts_have_the_tokens_of_whole_ones():
    rng = random.Random(2)
    alphabet = [*"ab'sé1. \n\t  ", "᠎", "\x85", "日", "\U0001f600", "　", "\x1c"]
    more = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(3_000)]
    for text in ODD + more:
        a, b = [], []
        for part in T.segments(text):
            x, y = T.encoded(part)
            a += [i for w in x for i in w]
            b += [i for w in y for i in w]
        assert a == T.a.encode(" " + text, add_special_tokens=False).ids and b == T.b.encode(text), repr(text)
    assert T.cuts


def test_joined_words_have_their_own_tokens():
    """Many words encoded as one text, by the faster encoder where they are ASCII, have the tokens of each by itself."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz'ABC019.,-_/\n\t"
    words = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(5_000)} | {w + "é" for w in ("", "a", "日本", "x\n")} | {" double", "end ", "y" * 900, "▁", "a▁b"})
    x = crosstoken.Aligned(T, words, strings=True)
    assert sorted(x.words) == sorted(words)
    a, b = T.encoded(x.words)
    cut = lambda ids, n: [ids[e - k : e].tolist() for k, e in zip(n, np.cumsum(n))]
    assert [w for w, ok in zip(x.words, x.ok) if not ok] == [w for w in x.words if "▁" in w]
    assert [i if ok else [] for i, ok in zip(a, x.ok)] == cut(x.a, x.n_a) and [i if ok else [] for i, ok in zip(b, x.ok)] == cut(x.b, x.n_b)
    for w, ok, i, j, s, links, n in zip(x.words, x.ok, a, b, x.strings, x.n_links, x.n_groups):
        if ok:
            assert s == ";".join(groups(i, j)) + ";" and links == len(linked(i, j)) and n == len(groups(i, j))


def test_odd_texts_in_small_steps(spark, tmp_path, monkeypatch):
    """Segments, remembered words and shards of a few entries each; the counts are those of brute force."""
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["the", "cat", "Größe", "naïve", "x\ny", "", "1999", "日本語"]) for _ in range(rng.randint(1, 80))) for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/counts"
    files = crosstoken.pair_counts(docs, folder, most=7)
    want, counts = wanted(list(enumerate(texts)))
    found = crosstoken.pair_table(files, folder).collect()
    assert {(r.a_id, r.b_id): r.n for r in found} == dict(counts) and len(found) == len(counts)
    known = crosstoken.shards(files, folder)
    assert len(known.paths) > 1
    same([tuple(r) for r in crosstoken.aligned(docs, known, most=7).collect()], want)
    monkeypatch.setattr(crosstoken, "SEGMENT", 20)
    bad = "a▁b " * 20 + "good words here"
    b = docs.limit(0).union(docs.sparkSession.createDataFrame([(1, "the cat " * 30), (2, bad), (3, "a x▁y"), (4, "the cat")], docs.schema)).toArrow().to_batches()
    w = crosstoken.Words(T)
    got = [(r, len(x), s.tolist()) for r, x, s in crosstoken.numbered(w, b[0], 1)] if len(b) == 1 else None
    assert got is None or ({r for rows, *_ in got for r in rows} == {0, 3} and sum(n for rows, n, _ in got if rows == [0]) >= 60)
    assert sum(1 for _ in T.segments(texts[-3])) > 1
    words = crosstoken.Words(T, strings=True, shards=known)
    for i, t in enumerate(texts):
        if t and want[i][1]:
            x = np.concatenate([words.of(p) for p in T.segments(t)])
            assert tuple(words.table[x].sum(axis=0).tolist()) == want[i][1:7]


def test_a_pair_that_was_not_counted_is_an_error(spark, tmp_path):
    folder = f"file://{tmp_path}/counts"
    files = crosstoken.pair_counts(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), folder)
    with pytest.raises(ValueError, match="not counted"):
        crosstoken.shards(files, folder).counts(np.array([5], np.int64))


def test_documents_are_read_whole(spark, tables, rows):
    """The counts cover every document, held-out or not."""
    got = registry.QUERIES["op13_token_alignment"](spark, tables)
    assert got.count() == len(rows) == documents(spark, tables).count()


def test_words_with_marks_take_the_faster_encoder(monkeypatch):
    """Latin letters with marks are encoded by it, with the ids of the file's own tokenizer, and B gets new words in parts."""
    t = crosstoken.Tokenizers()
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcxyzéèñüßçÈÀøŁğ.,;:!?'0123-\n×÷") for _ in range(rng.randint(1, 14))).strip() or "x" for _ in range(6000)})
    assert all(crosstoken.LATIN(w) for w in words) and not any(map(crosstoken.LATIN, ("a ", "a\n", "", "a\x85", "a\xa0b", "中", "á", "a" * 200)))
    a, b = t.encoded(words)
    monkeypatch.setattr(crosstoken.Tokenizers, "encoded", None)
    monkeypatch.setattr(crosstoken, "PIECED", 500)
    ids_a, n_a, ids_b, n_b = t.joined(words, True)
    assert ids_a.tolist() == [i for x in a for i in x] and n_a.tolist() == [len(x) for x in a]
    assert ids_b.tolist() == [i for x in b for i in x] and n_b.tolist() == [len(x) for x in b]
    x = crosstoken.Aligned(t, words, False)
    assert x.words == words and x.ok.all()


def test_cuts_equal_the_expression():
    rng = random.Random(9)
    for _ in range(4000):
        text = "".join(rng.choice("ab   \n\t\x85\xa0᠎　é\x1c") for _ in range(rng.randint(0, 9)))
        assert crosstoken.cut(text) == crosstoken.PLACE.split(text)
