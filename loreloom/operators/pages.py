"""Web pages and the catalog: titles, links, plain text, neighbours, categories and mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.text import normal


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.btrim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href): every link in order of occurrence."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("pos", "href"))


def plain_text(pages: DataFrame) -> DataFrame:
    """Text without head, script, style, nav, footer and tags; entities decoded, white space squeezed."""
    text = F.col("html")
    for tag in ("head", "script", "style", "nav", "footer"):
        text = F.regexp_replace(text, f"(?s)<{tag}[^>]*>.*?</{tag}>", " ")
    text = F.regexp_replace(F.regexp_replace(text, "(?s)<!--.*?-->", " "), "<[^>]*>", " ")
    for name, value in {"&nbsp;": " ", "&gt;": ">", "&lt;": "<", "&quot;": '"', "&amp;": "&"}.items():
        text = F.replace(text, F.lit(name), F.lit(value))
    return pages.select("page_id", F.btrim(F.regexp_replace(text, "[ \\t\\n\\r]+", " ")).alias("text"))


def host_rollup(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


def neighbours(pages: DataFrame, most: int = 3) -> DataFrame:
    """Pages that a page's links lead to, by link text path equal to another page's title's first word; first `most`."""
    first_word = F.split(F.btrim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), " ")[0]
    targets = pages.select(F.concat(F.lit("/"), first_word).alias("href"), F.col("page_id").alias("target")).groupBy("href").agg(F.max("target").alias("target"))
    found = links(pages).join(targets, "href").where("page_id <> target").groupBy("page_id", "target").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("page_id").orderBy("pos")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("page_id", "rank", "target")


def shared_links(pages: DataFrame) -> DataFrame:
    """(href, pages) of links that several pages have."""
    return links(pages).groupBy("href").agg(F.count_distinct("page_id").alias("pages")).where("pages > 1")


def category_sizes(members: DataFrame, category: str) -> DataFrame:
    return members.groupBy(category).agg(F.count("*").alias("members")).where(F.col(category).isNotNull())


def category_samples(members: DataFrame, category: str, key: str, most: int = 20) -> DataFrame:
    """The first `most` members of each category."""
    order = Window.partitionBy(category).orderBy(key)
    return members.where(F.col(category).isNotNull()).select(category, key).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def contained(queries: DataFrame, texts: DataFrame, query_key: str, query: str, text_key: str, text: str) -> DataFrame:
    """(query_key, text_key) where a normalised query occurs in a text on word boundaries.

    Long texts meet short queries by a shared word first (the longest of the query), so that
    no pair is tested without one.
    """
    words = lambda c: F.filter(F.split(normal(c), " "), lambda w: w != "")
    longest = F.array_max(F.transform(words(query), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    q = queries.select(F.col(query_key).alias("q"), normal(query).alias("needle"), longest.alias("word")).where("word is not null")
    t = texts.select(F.col(text_key).alias("t"), normal(text).alias("hay"))
    pairs = t.select("t", F.explode(F.array_distinct(F.split("hay", " "))).alias("word")).join(F.broadcast(q.select("q", "word")), "word").select("q", "t").distinct()
    tested = pairs.join(q.select("q", "needle"), "q").join(t, "t").where(F.contains(F.concat(F.lit(" "), "hay", F.lit(" ")), F.concat(F.lit(" "), "needle", F.lit(" "))))
    return tested.select(F.col("q").alias(query_key), F.col("t").alias(text_key))
