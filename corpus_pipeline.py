"""The training-data pipeline over ``documents``: five stages, each of which reads what the one before has kept.

``language`` drops documents without a recognisable language, ``near_duplicates`` keeps one document of each group of similar ones,
``decontaminate`` drops documents that hold benchmark passages, ``mix`` takes documents as often as their source's target asks
and ``shard`` gives each taken copy its place.

All stages return the columns of their input, of any type and name; the last adds its two, with underscores before the name where the
input has a column of that name.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, jaccard_join, langid, mixing, sharding
from quarry.llm.common import documents, masked, unused, written

SHARDS = 40
#: Documents whose nearest prototype is not even this near, in cosine, have no recognisable language.
LEAST_COSINE = 0.02


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognisable language.

    Null texts, texts without a letter and texts that are nearer than ``LEAST_COSINE`` to no language go; so does everything if no document
    that may teach has a language.  Repeated rows have one verdict each; a null key or source changes nothing.
    """
    own, (key, text, lang), back = masked(docs, "doc_id", "text", "lang")
    model = langid.learned(own.filter(langid.fraction(F.col(key), 3) != 1), text=text, lang=lang, key=key)
    found = langid.identified(own, model, text=text)
    return back(found.filter((F.col("_q_lang") != langid.UNKNOWN) & (F.col("_q_score") >= LEAST_COSINE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least key (nulls last), of each group of texts that are linked by 80 % of their five-word shingles.

    Repeated rows and equal texts are one group; of rows equal in key and text one stays.  Blank and null texts are groups of their own.
    """
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth, or none, stand in passages of 13 words of ``benchmark``.

    Null and blank texts stay.  Repeated rows go or stay together; an empty benchmark drops nothing.
    """
    return decontam.removed_documents(docs, documents(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often, up to three times, as its source's target of words asks.

    Null sources are one source.  Texts without words have no size: they are copied by their source's complete epochs, and once more if
    their draw is early.  Rows that are equal in key and size are taken alike.
    """
    return mixing.copied(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``: ``SHARDS`` shards whose counts differ by one at most.

    Rows are numbered by key (null first), then by the text's CRC, a null text counting as empty; equal rows are interchangeable.
    """
    crc = unused(docs, "_q_crc")
    rows = docs.withColumn(crc, F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return sharding.sharded(rows, SHARDS, ties=(crc,)).drop(crc)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]
#: The first stage is a learned model, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
