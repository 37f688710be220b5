"""The fill-in-middle transformation against a plain version in Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import fim, registry


def plain_version(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    hx = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hx[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["", None, "\n", "\n\n\n", "a", "a\n", "a\nb", "\na", "a\r\nb\n", "x<P>y\n", "<S", "<S>\n", "a\n<M>", "<\n<\n>\n", "S>\nP>\nM>\n<", "\U0001f600\n\U0001f601\n\U0001f602", "é z\n\u0085q\n", "line\n" * 3000, " \t\x00\n\x0b"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query_on_messy_tables(spark, tables, rows):
    got = sorted((tuple(r) for r in registry.QUERIES["op11_fill_in_middle"](spark, tables).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        *head, out = plain_version(i, t)
        want.append((i, *head, sha(out), sha(t or "")))
    assert got == sorted(want, key=repr)


def test_odd_texts_come_back(spark):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab\n<>SPM") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id int, text string, form string")
    got = fim.transformed(docs)
    assert got.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = got.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(found) == len(texts)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(r.doc_id, r.text)
        assert r.again == (r.text or "")
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_rates(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id int, text string")
    for r in fim.transformed(docs, rate=40, spm=10).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(r.doc_id, r.text, 40, 10)


@pytest.mark.parametrize("inside", [r"\n", r"\x20\t-\r", "0-9", "a-cé", "\U0001f600-\U0001f602"])
@pytest.mark.parametrize("shape", ["ended", "trailing", "leading", "runs"])
def test_boundaries_are_those_of_the_grammar(spark, inside, shape):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\n\t19\U0001f600\U0001f605") for _ in range(rng.randint(1, 40))) for _ in range(120)] + [t for t in ODD if t]
    g = fim.Grammar(inside, shape)
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in docs.select("text", fim.pieces(F.col("text"), g).alias("u")).collect():
        assert r.u == re.findall(g.units, r.text)


def test_no_python_in_the_plan(spark, tables):
    plan = registry.QUERIES["op11_fill_in_middle"](spark, tables)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan
