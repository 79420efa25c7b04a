import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from loreloom.llm.decontaminate import benchmark_hits
from loreloom.llm.minhash import near_duplicates
from loreloom.llm.quality import Resampler


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    judged = Resampler(docs, spark.read.parquet(f"{sf}/labels.parquet")).judged().where("selected").select("doc_id")
    left = docs.join(judged, "doc_id", "left_semi")
    kept = near_duplicates(left).where("kept").select("doc_id")
    clean = benchmark_hits(left.join(kept, "doc_id", "left_semi"), items).where("n_hit = 0").select("doc_id")
    expected = {r["doc_id"]: r["text"] for r in left.join(clean, "doc_id", "left_semi").collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(expected) and 0 < len(got) < docs.count()
    for doc, row in got.items():
        assert row["decoded_sha256"] == hashlib.sha256(expected[doc].encode()).hexdigest()
        assert row["n_tokens"] == len(row["ids"])


def test_odd_documents(spark, tmp_path):
    rows = [(i, f"plain words number {i} of a small corpus with text", "en", "s", 1) for i in range(30)] + [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "a text without an id", "en", "s", 3), (5, "plain words number 5 of a small corpus with text", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "words number 7 of a small corpus")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    folder = str(tmp_path)
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.columns == docs.columns, name
    ids = [r["doc_id"] for r in now.select(F.col("doc_id")).collect()]
    assert None in ids and 1001 not in ids and 7 not in ids and 5 in ids


def test_near_dedup_keeps_one_row_of_each_component(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(7, text("a")), (7, text("a")), (3, text("a")), (7, text("b")), (9, text("b")), (None, text("c")), (None, text("c")), (None, text("d")), (4, text("d")), (3, text("e")), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    expected = [(3, text("a")), (7, text("b")), (None, text("c")), (4, text("d")), (3, text("e")), (None, None), (8, "")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
