"""A training corpus from raw documents, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all that the one before kept.  Its
result is written as Parquet and read again as the next one's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import jaccard, packing, pii, quality, repeats
from rowloom.llm.common import Scratch, table
from rowloom.llm.queries import pii_key, vocabulary

SHINGLE_WORDS, SIMILARITY = 5, 80  # of near-duplicates: words, and per cent of the union
REPEAT_BYTES = 50


def recounted(docs: DataFrame) -> DataFrame:
    """With ``n_chars`` of the text as it is now; a null text leaves it."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    A null or empty text has no words and goes; a null lang or source is a group of its own.  Each of repeated rows is judged,
    and so alike.  Here and in the following stages very long texts are taken whole, an empty table gives
    an empty one, and further columns of any name are kept.
    """
    return quality.keep_good(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of least id.

    Rows of null id and texts without words all stay; of equal rows one stays; different texts of one id are documents of their own.
    """
    return jaccard.one_of_each(docs, SHINGLE_WORDS, SIMILARITY)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; those with nothing left go.

    null, empty and short texts and rows of null id lose nothing; texts of one id are judged each on its own.
    """
    return recounted(repeats.remove_repeats(docs, REPEAT_BYTES))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates, keyed by the session; null and empty texts stay, and no row goes."""
    return recounted(pii.anonymise(docs, pii_key(spark)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, a row per piece of a document; a null or empty text is its end id alone."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("suffix-array dedup", repeats_stage),
    ("PII", pii_stage),
    ("packing", packing_stage),
]

#: The stages split texts into tokens and search for similar ones; SQL doesn't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage has read is given free when its outcome is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs, at = stage(spark, docs, sf_dir), Scratch(spark, f"stage{k}")
        docs = at.write(docs, "docs")
        if before:
            before.drop()
        before = at
    before.drop_at_end()
    return docs
