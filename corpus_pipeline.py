"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token files.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as
Parquet and read again as the next one's docs.  All but the last return the
columns of ``documents``, and each works on all rows its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainspark.llm import decontaminate, language_id, minhash_dedup, mixing, token_files
from strainspark.scratch import Scratch

#: Documents whose language has a lower probability are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language; the model learns from the labels outside the held-out fifth."""
    model = language_id.fit(docs.filter(~language_id.is_held_out()))
    marked = docs.withColumn("__language", language_id.identify(docs, model))
    kept = (F.col("__language.lang_pred") != language_id.UNDETERMINED) & (F.col("__language.score") >= LEAST_SCORE)
    return marked.filter(kept).drop("__language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the smallest id; of its repeated rows, one.

    Rows of one id with different texts are judged each by its own text.  Rows of a
    null id aren't told apart and stay.
    """
    groups = minhash_dedup.near_duplicates(docs).filter("kept").groupBy("doc_id", "group").agg(F.min("text_hash").alias("__hash"), F.count("*").alias("__n"))
    chosen = groups.select(F.col("doc_id").alias("__id"), "__hash", "__n")
    kept = docs.join(chosen, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    once = kept.filter("__n = 1").drop("__id", "__hash", "__n")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "doc_id"]
    first = kept.filter("__n > 1").groupBy("doc_id", "__hash").agg(F.min(F.struct(*rest)).alias("__row"))
    return once.unionByName(first.select("doc_id", "__row.*")).unionByName(docs.filter("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    marked = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="__found")
    return marked.filter(F.size("__found.spans") == 0).drop("__found")


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by their calibrated probabilities."""
    marked = mixing.with_probability(docs, out="__mix")
    return marked.filter("__mix.kept").drop("__mix")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; one row for each document, read back from them."""
    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontaminate", decontaminated),
    ("mixing", mixed_to_targets),
    ("token_files", encoded),
]

#: SQL has no tokenizer, MinHash or trained classifier; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
