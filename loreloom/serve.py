"""The tools over a knowledge base: search, fetch, list_category, route and map."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions.text import SEARCH_STOP, normal, shortened
from loreloom.operators import catalog, graph, raster, resolve, search


@dataclass(frozen=True)
class Limits:
    query: int = 1200
    snippet: int = 180
    fetch: int = 4000
    hits: int = 20
    sure: float = 0.66
    likely: float = 0.4


@dataclass
class KnowledgeBase:
    """Tables of parsed pages (see sources.bundle), and optionally of a graph and of tiles."""

    spark: SparkSession
    pages: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    tiles: DataFrame | None = None
    limits: Limits = Limits()

    def search(self, query: str, k: int = 6) -> DataFrame:
        """(concept_id, title, snippet, score); pages of maps come last."""
        text = query[: self.limits.query]
        if "hafen" in text.lower():
            text += " steg anleger schiff"
        lowered = text.lower().translate(str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}))
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in lowered).split()
        terms = [w for w in words if len(w) >= 2 and w not in SEARCH_STOP]
        hits = search.bm25(self.pages, terms, min(k, self.limits.hits), "concept_id", "body")
        found = hits.join(self.pages, hits["doc_id"] == self.pages["concept_id"]).select("concept_id", "title", shortened("body", self.limits.snippet).alias("snippet"), "score")
        return found.orderBy(F.col("title").startswith("Karte/"), F.desc("score"), "concept_id")

    def fetch(self, concept_id: str) -> DataFrame:
        """(concept_id, title, body, neighbours, variants) of one page, a redirect followed."""
        goal = catalog.resolved(self.pages).where(F.col("concept_id") == concept_id).select(F.col("resolved").alias("concept_id"))
        page = self.pages.join(goal, "concept_id").select("concept_id", "title", shortened("body", self.limits.fetch).alias("body"))
        near = catalog.neighbours(self.pages).groupBy("concept_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("neighbours"))
        kinds = catalog.variants(self.pages).groupBy("title").agg(F.sort_array(F.collect_list("variant")).alias("variants"))
        return page.join(near, "concept_id", "left").join(kinds, "title", "left").select("concept_id", "title", "body", "neighbours", "variants")

    def list_category(self, query: str) -> DataFrame:
        """(category, count, concept_id, title): members of the category that a query names, longest form first."""
        forms = catalog.category_forms(self.pages).withColumn("q", F.concat(F.lit(" "), normal(F.lit(query)), F.lit(" ")))
        named = forms.where(F.contains("q", F.concat(F.lit(" "), "form", F.lit(" ")))).orderBy(F.desc(F.length("form")), "category").limit(1).select("category")
        members = catalog.members(self.pages).join(named, "category")
        count = members.groupBy("category").agg(F.count("*").alias("count"))
        return members.join(count, "category").join(self.pages.select("concept_id", "title", "namespace"), "concept_id").where("namespace <> 14").select("category", "count", "concept_id", "title").orderBy("title")

    def route(self, start: str, goal: str) -> DataFrame:
        """(step, src, dst, command) of the cheapest way between two named rooms; no rows without one."""
        asked = self.spark.createDataFrame([(start,), (goal,)], "query string")
        names = {r["query"]: r["id"] for r in resolve.resolve(asked, self.nodes).collect()}
        none = self.spark.createDataFrame([], "step int, src string, dst string, command string")
        if start not in names or goal not in names or names[start] == names[goal]:
            return none
        source = self.spark.createDataFrame([(names[start],)], "source string")
        tree = graph.shortest_paths(self.edges, source)
        # The way back from the goal is as long as the route, not as the graph.
        steps, at = [], names[goal]
        while at != names[start]:
            row = tree.where(F.col("node") == at).select("pred").first()
            if row is None or row["pred"] is None:
                return none
            steps.append((row["pred"], at))
            at = row["pred"]
        way = self.spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(reversed(steps))], "step int, src string, dst string")
        best = self.edges.groupBy("src", "dst").agg(F.min_by("command", "weight").alias("command"))
        return way.join(best, ["src", "dst"], "left").select("step", "src", "dst", "command").orderBy("step")

    def map(self, region: str) -> DataFrame:
        """(row, line) of a region's tiles, drawn."""
        return raster.drawn(self.tiles.where(F.col("region") == region)).select("row", "line").orderBy("row")
