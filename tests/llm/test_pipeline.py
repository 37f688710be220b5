"""The pipeline's stages, one after the other, against brute force on what each has got."""

import collections

import pytest

import corpus_pipeline
from quarry.llm.common import documents

from . import brute


def test_stages(spark, tables):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontaminate", "mix", "shard"]
    docs = documents(spark, tables)
    columns = docs.columns

    def step(name):
        nonlocal docs
        before = docs.collect()
        out = stages[name](spark, docs, tables)
        rows = out.collect()
        assert out.columns[: len(columns)] == columns and (name == "shard" or out.columns == columns)
        docs = spark.createDataFrame(rows, out.schema)
        return before, rows

    before, rows = step("language")
    silent = [r for r in before if not any(c.isalpha() for c in r.text or "")]
    assert collections.Counter(rows) == collections.Counter(before) - collections.Counter(silent)

    before, rows = step("near_duplicates")
    groups = collections.defaultdict(list)
    for r, (n, g) in zip(before, brute.components([r.text for r in before], 5, 80), strict=True):
        groups[g].append(r)
    least = [min(((r.doc_id is None, r.doc_id) for r in g), key=lambda x: (x[0], x[1] or 0)) for g in groups.values()]
    assert collections.Counter((r.doc_id is None, r.doc_id) for r in rows) == collections.Counter(least)

    before, rows = step("decontaminate")
    bench = [(r.item_id, r.text) for r in documents(spark, tables, "benchmark").collect()]
    dirty = [h > 0 and 20 * h >= n for n, h, _ in brute.contamination([r.text for r in before], bench)]
    assert any(dirty)
    assert collections.Counter(rows) == collections.Counter(r for r, d in zip(before, dirty, strict=True) if not d)

    before, rows = step("mix")
    size = lambda r: len(brute.WORD.findall(r.text or ""))
    own, taken, biggest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in before:
        own[r.source] += size(r)
        biggest[r.source] = max(biggest[r.source], size(r))
    for r in rows:
        taken[r.source] += size(r)
    for source, target in brute.targets(dict(own)).items():
        assert abs(taken[source] - target) <= biggest[source]
    assert max(collections.Counter(rows).values()) <= 3 * max(collections.Counter(before).values())
    assert set(rows) <= set(before)

    before, rows = step("shard")
    places = collections.defaultdict(list)
    for r in rows:
        # the table has columns of these names already
        places[r["_shard"]].append(r["_slot"])
    counts = [len(places.get(i, [])) for i in range(corpus_pipeline.SHARDS)]
    assert sum(counts) == len(before) and max(counts) - min(counts) <= 1
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_run_is_the_stages(spark, tables):
    a = corpus_pipeline.run(spark, tables)
    b = corpus_pipeline.run(spark, tables)
    assert a.columns[-2:] == ["_shard", "_slot"]
    pick = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    assert pick(a) == pick(b)


@pytest.mark.parametrize("name", ["language", "near_duplicates", "decontaminate", "mix", "shard"])
def test_stage_on_nothing(spark, empty, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, documents(spark, empty), empty).count() == 0
