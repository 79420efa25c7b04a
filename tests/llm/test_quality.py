import numpy as np
from pyspark.sql import functions as F

from loreloom.llm.quality import Resampler, kth_largest
from loreloom.llm.registry import op4_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    judged = Resampler(docs, labels.where(~held)).judged()
    rows = judged.join(labels.where(held), "doc_id").select("selected", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).toPandas()
    assert len(rows) > 50
    assert rows[rows.good].selected.mean() > 0.9
    assert rows[~rows.good].selected.mean() < 0.6


def test_query_has_every_document(spark, sf):
    rows = op4_quality(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    kept = [r["sample_key"] for r in rows if r["selected"]]
    assert kept and min(kept) > max((r["sample_key"] for r in rows if not r["selected"]), default=float("-inf"))


def test_kth_largest(spark):
    values = np.random.default_rng(1).normal(size=3000).tolist() + [5.0] * 40 + [float("-inf")] * 7
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 10, 41, 1500, 3040):
        assert kth_largest(df, "x", k) == (sorted(values)[-k] if k < 3040 else float("-inf"))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "fine words here", 1.0), (2, None, 2.0), (3, "", 3.0), (4, "x " * 40_000, 4.0), (None, "fine words here", 5.0), (1, "fine words here", 6.0)], "doc_id bigint, text string, ratio double")
    labels = spark.createDataFrame([(1, 1, None), (9, 0, 1), (None, 1, 0), (4, None, 0)], "doc_id bigint, quality int, toxic int")
    fitted = Resampler(docs, labels)
    assert fitted.judged().count() == 6
    kept = fitted.filter(docs)
    assert kept.columns == docs.columns
    assert sorted(r["ratio"] for r in kept.collect()) == [1.0, 4.0, 5.0, 6.0]
    assert Resampler(docs.limit(0), labels).filter(docs.limit(0)).count() == 0
    assert Resampler(docs, labels.limit(0)).filter(docs).count() == 4


def test_signed_ratio_of_all_grams_with_noise_of_scale_one(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fitted = Resampler(docs, labels)
    rows = fitted.judged().toPandas()
    rows = rows[rows.n_grams > 0]
    assert (rows.ratio == 0).mean() < 0.01 and (rows.ratio > 0).any() and (rows.ratio < 0).any()
    assert 1 < (rows.sample_key - rows.ratio).std() < 1.6
    # The sample isn't the plain threshold.
    assert (rows.selected != (rows.ratio > 0)).any()
    assert sorted(r[0] for r in fitted.filter(docs).select("doc_id").collect()) == sorted(rows.doc_id[rows.selected])


def test_length_alone_moves_nothing(spark):
    good, bad, plain = ([f"{kind}{i}" for i in range(30)] for kind in ("fine", "poor", "word"))
    text = lambda i, telling, n: " ".join([telling[(i + j) % 30] if j % 5 == 0 else plain[(7 * i + j) % 30] for j in range(n)])
    rows = [(i, text(i, good if i % 2 else bad, 10 if i % 4 < 2 else 400)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    for r in Resampler(docs, labels).judged().where("doc_id >= 200").collect():
        assert (r["ratio"] > 0) == (r["doc_id"] % 2 == 1), r


def test_carried_rows_are_those_that_filter_keeps(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.withColumnRenamed("lang", "n_grams").withColumnRenamed("source", "__0")
    fitted = Resampler(docs, labels, carry=True)
    assert fitted.kept().columns == docs.columns
    assert sorted(map(str, fitted.kept().collect())) == sorted(map(str, Resampler(docs, labels).filter(docs).collect()))
