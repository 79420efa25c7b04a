"""Queries of this package over the tables of a folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm import bpe
from loreloom.llm.decontaminate import benchmark_hits
from loreloom.llm.lm_score import score_documents
from loreloom.llm.minhash import near_duplicates
from loreloom.llm.packing import pack_documents
from loreloom.llm.pq import near_duplicate_vectors
from loreloom.llm.quality import resample
from loreloom.llm.sharding import shard_documents
from loreloom.llm.token_files import document_token_counts
from loreloom.llm.url_filter import Rule, judge_urls

#: Fixed rules of the URL query.
URL_RULES = [Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block")]


#: The id that the vocabulary leaves free.
END_OF_DOCUMENT = 50256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return document_token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, END_OF_DOCUMENT)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return pack_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, pad=END_OF_DOCUMENT)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_URL_SQL = r"""
with u as (
    select page_id, coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') as raw_host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
    from pages
), h as (
    select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u
), r(rule_host, rule_path, verdict) as (
    values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m as (
    select h.*, r.rule_host || r.rule_path as rule, r.verdict,
           row_number() over (partition by page_id order by length(r.rule_host) desc nulls last, length(r.rule_path) desc) as n
    from h left join r on (h.host = r.rule_host or ends_with(h.host, '.' || r.rule_host)) and starts_with(h.path, r.rule_path)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from m where n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": _URL_SQL}
