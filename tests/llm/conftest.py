import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, alphabet="abcdefghij"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n))


def messy():
    """Rows with nulls in any column, empty and very long texts, ties and repeated rows, near and exact copies."""
    rng = random.Random(7)
    a, b = words(rng, 120), words(rng, 300)
    passage = words(rng, 60)
    near = a.split()
    near[60] = "changed"
    rows = [
        (1, a, "en", "s1"), (2, a, "en", "s2"), (3, " ".join(near), "en", "s1"), (4, b, "de", None), (4, b, "de", None), (5, None, "en", "s1"), (6, "", None, "s3"), (7, " \n\t ", "fr", "s3"),
        (None, b + " tail words here", "de", "s2"), (None, None, None, None), (8, passage + " " + words(rng, 30), "en", "s2"), (9, words(rng, 40) + " " + passage, "en", "s2"), (10, "one two", "en", "s4"), (11, "ONE  two", "en", "s4"),
        (12, "Größe É ﬁne ﬁne " + words(rng, 50, "äöüßabc"), "de", "s4"), (13, words(rng, 40_000), "en", "s1"), (14, "x" * 300, "en", "s1"), (15, "x" * 300, "fr", "s5"), (16, "12345 67890 !!!", "en", "s5"), (17, "mail a@b.co tel +1 (017) 555-7713 at 152.143.123.131 card 4111 1111 1111 1111", "en", "s5"),
        (18, "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License", "en", "s5"), (3, a, "en", "s1"), (19, passage, "en", "s2"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], passage


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder like the driver's, with messy documents that also have columns named like helpers of the operators."""
    d = str(tmp_path_factory.mktemp("tables"))
    rows, passage = messy()
    clash = ["h", "k", "t", "n", "len", "items", "spans", "gram", "sid", "vec", "label", "tie", "size", "b", "s", "me", "class", "a", "shard", "slot", "target", "_q_me", "_q_size", "_q_copy", "_q_source", "_q_key", "_q_hash", "_q_text", "_q_range", "_q_row", "_q_lang", "_q_c0", "_q_draw"]
    df = spark.createDataFrame(rows, DOCS)
    for c in clash:
        df = df.selectExpr("*", f"'clash' AS `{c}`")
    df.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "ONE two"), (3, None), (None, "..."), (4, passage + " more of it")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0), (8, 1, 0), (16, 0, 0), (None, 1, 0), (9, None, 0), (13, 0, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def rows():
    return messy()[0]
