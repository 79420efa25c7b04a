"""Markdown bundles: a folder of pages with front matter, read into one row a page and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions.text import outbound_links, without_citations, yaml_scalar

#: Names of files that are no pages.
RESERVED = ("index.md", "log.md")


def read_bundle(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(concept_id, raw) of every page below folder; Spark leaves out `_` folders, so those wanted are named in extra."""
    found = spark.read.text([folder, *(f"{folder}/{x}" for x in extra)], wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    root = F.lit(folder.split("://")[-1].rstrip("/") + "/")
    inside = F.expr("substring(p, locate(r, p) + length(r))")
    named = found.select(F.col("value").alias("raw"), path.alias("p"), root.alias("r")).select("raw", inside.alias("file"))
    return named.where(~F.element_at(F.split("file", "/"), -1).isin(*RESERVED)).select(F.regexp_replace("file", r"\.md$", "").alias("concept_id"), "raw")


def _field(front, name: str):
    value = F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*)$", 1)
    plain = F.btrim(F.regexp_replace(value, r'^"(.*)"\s*$', "$1"))
    return F.when(plain == "", None).otherwise(F.replace(plain, F.lit('\\"'), F.lit('"')))


def parse_pages(raw: DataFrame) -> DataFrame:
    """Front matter as columns, with defaults, and the body without its citations."""
    front = F.regexp_extract("raw", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    body = F.regexp_replace("raw", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    tags = F.regexp_extract(front, r"(?m)^tags:[ \t]*\[(.*)\]", 1)
    return raw.select(
        "concept_id",
        F.coalesce(_field(front, "title"), F.element_at(F.split("concept_id", "/"), -1)).alias("title"),
        F.coalesce(_field(front, "type"), F.lit("Wiki Article")).alias("type"),
        _field(front, "description").alias("description"),
        _field(front, "resource").alias("url"),
        F.filter(F.transform(F.split(tags, ","), lambda x: F.btrim(F.regexp_replace(x, '"', ""))), lambda x: x != "").alias("tags"),
        F.coalesce(_field(front, "namespace").try_cast("int"), F.lit(0)).alias("namespace"),
        _field(front, "revid").try_cast("bigint").alias("revid"),
        F.regexp_replace(without_citations(body), r"^\s+|\s+$", "").alias("body"),
        outbound_links(body, "concept_id").alias("links"),
    )


def render_pages(pages: DataFrame) -> DataFrame:
    """(concept_id, raw): pages as markdown with front matter."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    tags = F.concat(F.lit("["), F.array_join(F.transform("tags", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", "), F.lit("]"))
    front = F.concat_ws("\n", F.lit("---"), line("type", yaml_scalar("type")), line("title", yaml_scalar("title")), line("description", yaml_scalar("description")), line("resource", yaml_scalar("url")), line("tags", tags), line("revid", F.col("revid").cast("string")), line("namespace", F.col("namespace").cast("string")), F.lit("---"))
    cited = F.when(F.col("url").isNotNull(), F.concat(F.lit("\n\n# Citations\n\n[1] "), F.col("url"), F.lit("\n"))).otherwise(F.lit("\n"))
    return pages.select("concept_id", F.concat(front, F.lit("\n\n"), F.col("body"), cited).alias("raw"))
