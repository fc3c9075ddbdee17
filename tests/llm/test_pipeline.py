"""Stages of the pipeline, each on its own input."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_act(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    junk = spark.createDataFrame([(-1, "?? !!", "en", "src0", 5), (-2, None, "en", "src0", None)], docs.schema)
    copy = docs.filter("length(text) > 200").limit(1).withColumn("doc_id", F.lit(10**9).cast("long"))
    item = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    leak = spark.createDataFrame([(10**9 + 1, "intro " + item + " outro", "en", "src0", 9)], docs.schema)
    docs = docs.union(junk).union(copy).union(leak)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "minhash_dedup", "decontaminate", "mixing", "token_files"]

    spoken = stages["language_id"](spark, docs, data)
    ids = {r.doc_id for r in spoken.collect()}
    assert spoken.columns == columns and not ids & {-1, -2} and len(ids) >= docs.count() - 10
    single = stages["minhash_dedup"](spark, docs, data)
    kept = [r.doc_id for r in single.collect()]
    assert single.columns == columns and len(kept) == len(set(kept)) and 10**9 not in kept and {-1, -2} <= set(kept)
    clean = stages["decontaminate"](spark, docs, data)
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == columns and 10**9 + 1 not in left and len(left) > 0.9 * docs.count()
    mixed = stages["mixing"](spark, docs, data)
    assert mixed.columns == columns and 0.2 * docs.count() < mixed.count() < docs.count()
    assert stages["token_files"](spark, docs, data).count() == docs.count()


def test_repeated_rows_leave_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(20)
    twice = docs.union(docs).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    out = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, twice, data).collect()]
    assert out.count(None) == 1 and len([x for x in out if x is not None]) == len({x for x in out if x is not None})


def test_rows_of_one_id_are_deduplicated_by_their_texts(spark, data):
    """Also texts that are null, empty or very long, and an extra column with a name the stages use."""
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    long = " ".join(f"word{k}" for k in range(40_000))
    rows = [(1, one, 0), (2, one + " end", 1), (2, two, 2), (2, two, 2), (3, two + " end", 3), (4, None, 4), (5, "", 5), (6, long, 6), (7, long + " end", 7), (None, one, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, data)
    assert out.columns == docs.columns and sorted(r.kept for r in out.collect()) == [0, 2, 4, 5, 6, 8]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), data).count() == 0


def test_run_is_its_stages(spark, data):
    out = corpus_pipeline.run(spark, data)
    rows = out.collect()
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
