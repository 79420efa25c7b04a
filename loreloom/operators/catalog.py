"""The catalog over parsed pages: redirects, members, neighbours, variants, and mentions in queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.text import compound_aliases, normal, percent_decoded


def redirects(pages: DataFrame) -> DataFrame:
    """(concept_id, target): pages that redirect, by a cue and a link that are both in their first 120 characters."""
    head = F.substring("body", 1, 120)
    goal = percent_decoded(F.regexp_extract(head, r"\]\(/([^)\s#]+?)\.md", 1))
    return pages.where(head.rlike("(?i)weiterleitung|redirect")).select("concept_id", goal.alias("target")).where("target <> ''")


def resolved(pages: DataFrame) -> DataFrame:
    """(concept_id, resolved): one redirect followed at most, and only to pages that exist."""
    goals = redirects(pages).join(pages.select(F.col("concept_id").alias("target")), "target")
    return pages.select("concept_id").join(goals, "concept_id", "left").select("concept_id", F.coalesce("target", "concept_id").alias("resolved"))


def titles(pages: DataFrame) -> DataFrame:
    """(title, concept_id): the page that each normalised title names.

    A redirect names its target; of several pages with one title the last counts (`pos`, else the
    id orders them). A redirect whose title is a natural compound of a category's name (see
    compound_aliases) names that category's page instead, whose namespace is 14.
    """
    order = "pos" if "pos" in pages.columns else "concept_id"
    named = pages.join(resolved(pages), "concept_id").select(normal("title").alias("title"), F.col("resolved").alias("concept_id"), F.col(order).alias("o"))
    last = named.groupBy("title").agg(F.max_by("concept_id", "o").alias("concept_id"))
    category = pages.where("namespace = 14").select(F.explode(compound_aliases(F.regexp_replace("title", "^[^:]+:", ""))).alias("form"), F.col("concept_id").alias("page"), F.col(order).alias("o"))
    by_form = category.select(normal("form").alias("title"), "page", "o").groupBy("title").agg(F.max_by("page", "o").alias("page"))
    moved = pages.join(redirects(pages).select("concept_id"), "concept_id", "left_semi").select(normal("title").alias("title")).distinct().join(by_form, "title")
    return last.join(moved, "title", "left").select("title", F.coalesce("page", "concept_id").alias("concept_id"))


def title_candidates(pages: DataFrame, shortest: int = 4) -> DataFrame:
    """(title, concept_id) of titles long enough to look for in a question, the longest first."""
    return titles(pages).where(F.length("title") >= shortest).orderBy(F.desc(F.length("title")), "title")


def members(pages: DataFrame) -> DataFrame:
    """(category, concept_id) of every tag of every page."""
    return pages.select(F.explode("tags").alias("category"), "concept_id")


def neighbours(pages: DataFrame) -> DataFrame:
    """(concept_id, pos, neighbour, title): outbound links that lead to a page, in order."""
    target = pages.select(F.col("concept_id").alias("neighbour"), "title")
    return pages.select("concept_id", F.posexplode("links").alias("pos", "neighbour")).join(target, "neighbour").select("concept_id", "pos", "neighbour", "title")


def variants(pages: DataFrame, most: int = 8) -> DataFrame:
    """(title, variant): up to `most` subpages of each title; the parent path makes it an equi-join."""
    parts = F.split(normal("title"), "/")
    child = pages.select(F.col("concept_id").alias("variant"), normal("title").alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("parent")).where("parent <> n")
    found = pages.select("title", normal("title").alias("parent")).join(child, "parent")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("title").orderBy("n"))).where(F.col("rank") <= most).select("title", "variant")


def category_forms(pages: DataFrame) -> DataFrame:
    """(category, form): names of categories and their natural compounds, normalised."""
    names = members(pages).select("category").distinct()
    return names.select("category", F.explode(F.array_union(F.array("category"), compound_aliases("category"))).alias("form")).select("category", normal("form").alias("form"))


def _spans(text: str, needle: str) -> Iterator[int]:
    at = text.find(needle)
    while at >= 0:
        if (at == 0 or not text[at - 1].isalnum()) and (at + len(needle) == len(text) or not text[at + len(needle)].isalnum()):
            yield at
        at = text.find(needle, at + 1)


def mentions(queries: DataFrame, titles: DataFrame, most: int = 3, shortest: int = 4) -> DataFrame:
    """(query_id, rank, concept_id): titles named in a query, longest first, without overlap.

    queries: query_id, text; titles: title, concept_id. Candidates share a whole first word with
    the query, which is an equi-join; choosing spans is sequential, one query at a time.
    """
    n = normal("title")
    named = titles.select(n.alias("title"), "concept_id", F.regexp_extract(n, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1).alias("word")).where((F.length("title") >= shortest) & (F.col("word") != ""))
    asked = queries.select("query_id", normal("text").alias("text"))
    words = asked.select("query_id", "text", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))).alias("word"))
    candidates = words.join(named, "word").where(F.contains("text", "title")).select("query_id", "text", "title", "concept_id")

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        text, taken, hits = part["text"].iloc[0], [], []
        part = part.assign(n=-part["title"].str.len()).sort_values(["n", "title", "concept_id"])
        for title, concept in zip(part["title"], part["concept_id"], strict=True):
            if len(hits) >= most:
                break
            free = next((i for i in _spans(text, title) if all(i >= e or i + len(title) <= s for s, e in taken)), None)
            if free is not None:
                taken.append((free, free + len(title)))
                if concept not in hits:
                    hits.append(concept)
        return pd.DataFrame({"query_id": part["query_id"].iloc[0], "rank": range(1, len(hits) + 1), "concept_id": hits})

    kinds = dict(candidates.dtypes)
    return candidates.groupBy("query_id").applyInPandas(choose, f"query_id {kinds['query_id']}, rank int, concept_id {kinds['concept_id']}")
