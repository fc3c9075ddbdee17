"""The queries of this subpackage, each over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strainspark.llm import (alignment, chat_format, decontaminate, embedding_dedup, filter_audit, fingerprints, language_id, line_dedup,
                             minhash_dedup, mixing, secrets, token_files, url_filter)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose crc32 of the id isn't divisible by 5."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.is_held_out()
    model = language_id.fit(docs.filter(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), language_id.identify(docs, model).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling probability and draw of every document, raked to smoothed marginals."""
    return mixing.report(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return chat_format.format_chats(_table(spark, sf_dir, "conversations"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in files, read back."""
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark windows cover."""
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal labels, by a cosine of 0.93."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents, five words and a similarity of 0.75."""
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line, exactly or nearly."""
    return line_dedup.report(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text."""
    return secrets.report(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_filter.report(_table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with the links' counts over all documents."""
    return alignment.report(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.report(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all orders."""
    return filter_audit.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_mixing, op3_chat_format, op4_token_files, op5_decontaminate, op6_embedding_dedup,
                            op7_minhash_dedup, op8_line_dedup, op9_secret_scan, op10_url_filter, op11_token_alignment, op12_fingerprints,
                            op13_filter_audit)
}

SQL: dict[str, str] = {
    "op2_mixing": mixing.report_sql(),
    "op3_chat_format": chat_format.REPORT_SQL,
    "op9_secret_scan": secrets.report_sql(),
    "op10_url_filter": url_filter.REPORT_SQL,
    "op12_fingerprints": fingerprints.report_sql(),
    "op13_filter_audit": filter_audit.REPORT_SQL,
}
