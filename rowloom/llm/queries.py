"""The registered queries of the corpus operators, each over its whole table, and SQL for those it can express."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import html, jaccard, licenses, packing, pii, quality, repeats, sentencepieces, topk, urls
from rowloom.llm.common import table
from rowloom.llm.oracles import ORACLE_SQL


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pii_key(spark: SparkSession) -> bytes:
    """The session's key of surrogates, ``spark.rowloom.pii.key``; where none is set, one is drawn for this session.

    Set it where surrogates of several runs are to agree.
    """
    key = spark.conf.get("spark.rowloom.pii.key", None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set("spark.rowloom.pii.key", key)
    return hashlib.blake2b(key.encode()).digest()


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), with_ids=False)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.checked(pii.replace_pii(table(spark, sf_dir, "documents"), pii_key(spark))).select("doc_id", "text", "n_entities", "kinds")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digest(table(spark, sf_dir, "documents"), length=50)


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), digest=True)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_packing, op4_pii, op5_main_text, op6_top_k, op7_repeats, op8_sentencepieces, op9_jaccard_join, op10_url_filter)}
