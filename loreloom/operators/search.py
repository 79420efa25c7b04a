"""Lexical, dense and fused top-k search.

The index is three tables: postings (term, doc, tf), document frequencies, and lengths. A
query of a stored index (bm25_index) touches the postings of its few terms only; the query side is a
literal list, so the term filter reaches the scan, and each ranking is a TakeOrdered. A table
without an index is ranked by one pass over its texts (bm25_ranked).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.text import search_tokens
from loreloom.plans.checkpoint import cut

K1, B = 1.5, 0.75
RRF_K = 60


@dataclass
class Index:
    postings: DataFrame
    frequencies: DataFrame
    lengths: DataFrame


def tokens_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    # An explode of one element keeps the optimizer from pasting the expression into every use of it.
    tokens = F.coalesce(search_tokens(text), F.array().cast("array<string>"))
    return docs.select(F.col(key).alias("doc_id"), F.explode(F.array(tokens)).alias("tokens"))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Documents without tokens count towards the number and the mean length of documents."""
    tokens = tokens_of(docs, key, text)
    postings = tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return Index(postings, postings.groupBy("term").agg(F.count("*").alias("df")), tokens.select("doc_id", F.size("tokens").cast("bigint").alias("len")))


def _weight(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """(doc_id, score, rank) of the k best by the exact score, then by the first query term that hit, then by id."""
    top = scored.orderBy(F.desc("exact"), "first", "doc_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("exact"), "first", "doc_id")) - 1
    return top.select("doc_id", F.round("exact", 6).alias("score"), rank.alias("rank"))


def bm25_index(index: Index, terms: list[str], k: int) -> DataFrame:
    """(doc_id, score, rank) of the k best documents of a stored index, of which only the postings of the terms are read."""
    terms = list(dict.fromkeys(terms))
    place = F.create_map(*(F.lit(x) for pair in zip(terms, range(len(terms)), strict=True) for x in pair)) if terms else F.create_map().cast("map<string,int>")
    totals = index.lengths.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    hit = index.postings.where(F.col("term").isin(terms)).join(F.broadcast(index.frequencies.where(F.col("term").isin(terms))), "term").join(index.lengths, "doc_id").join(F.broadcast(totals))
    number = lambda c: F.col(c).cast("double")
    weight = _weight(number("tf"), number("df"), number("n"), number("len"), F.col("mean"))
    return _best(hit.groupBy("doc_id").agg(F.sum(weight).alias("exact"), F.min(place[F.col("term")]).alias("first")), k)


def bm25_ranked(docs: DataFrame, terms: list[str], k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, rank) of the k best documents of a table that has no index.

    A query needs the lengths of all documents but the frequencies of its terms only,
    so those are counted in place and nothing else is exploded or shuffled.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return docs.select(F.col(key).alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    tokens = tokens_of(docs, key, text)

    def times(term: str) -> Column:
        return F.size(F.filter("tokens", lambda x: x == term)).cast("bigint")

    counts = [times(w) for w in terms]
    # Texts are read once: what both the totals and the scores need is a narrow table.
    facts = cut(tokens.select("doc_id", F.size("tokens").cast("double").alias("len"), *(c.alias(f"tf{i}") for i, c in enumerate(counts))))
    totals = facts.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))))
    hit = facts.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(totals))
    score, first = F.lit(0.0), F.lit(len(terms))
    for i in reversed(range(len(terms))):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        score = score + F.when(tf > 0, _weight(tf, df, F.col("n"), F.col("len"), F.col("mean"))).otherwise(0.0)
        first = F.when(tf > 0, i).otherwise(first)
    return _best(hit.select("doc_id", score.alias("exact"), first.alias("first")), k)


def bm25(docs: DataFrame, terms: list[str], k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of the k best documents. Ties go by the first query term that hit, then by id."""
    return bm25_ranked(docs, terms, k, key, text).select("doc_id", "score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine where a vector of length zero counts as of length one."""
    norm = lambda v: F.when(dot(v, v) == 0, F.lit(1.0)).otherwise(F.sqrt(dot(v, v)))
    return dot(a, b) / (norm(a) * norm(b))


def dense(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(doc_id, score) of the k vectors nearest to a query by cosine, exactly."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(F.col(key).alias("doc_id"), F.round(cosine(F.col(vector), literal), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def ranked(hits: DataFrame) -> DataFrame:
    """0-based ranks of a top-k result, which is small by construction."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1)


def fuse(first: DataFrame, second: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """(doc_id, score) by reciprocal rank fusion of two rankings; ties go to the first one's documents."""
    both = first.select("doc_id", "rank", F.lit(0).alias("side")).unionByName(second.select("doc_id", "rank", F.lit(1).alias("side")))
    best = both.groupBy("doc_id").agg(F.round(F.sum(F.lit(1.0) / (rrf_k + F.col("rank"))), 6).alias("score"), F.min(F.struct("side", "rank")).alias("seen"))
    return best.orderBy(F.desc("score"), "seen.side", "seen.rank").limit(k).select("doc_id", "score")


def nearest_categories(vectors: DataFrame, query: list[float], k: int, least: float, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Categories by the cosine of their mean vector: sort, threshold, then k."""
    parts = vectors.select(label, F.posexplode(vector)).groupBy(label, "pos").agg(F.avg(F.col("col").cast("double")).alias("x"))
    means = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
    literal = F.array(*(F.lit(float(x)) for x in query))
    return means.select(F.col(label), F.round(cosine(F.col("mean"), literal), 6).alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), label).limit(k)
