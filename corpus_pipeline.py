"""A corpus pipeline: quality, near-dedup, decontamination, then token ids.

Each stage takes what the one before kept and returns the columns of documents, but for the
last, which returns token ids. The near-dedup keeps exactly one row of each component, whatever
the rows' ids: the one of the least id, and a row without an id only where no other has one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm import bpe
from loreloom.llm.decontaminate import decontaminate
from loreloom.llm.minhash import near_duplicates
from loreloom.llm.quality import Resampler
from loreloom.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return Resampler(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True).kept()


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = Scratch(spark, "near-dedup").cut(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    judged = near_duplicates(rows, key="__row").select("__row", "component_id").join(rows.select("__row", "doc_id"), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "__row")).alias("first")
    kept = judged.groupBy("component_id").agg(first).select("first.__row")
    return rows.join(kept, "__row", "left_semi").select(docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path, decoded=True)
    return encoded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", benchmark), ("bpe", encoding)]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
