"""Graph operators over node and edge tables: shortest paths, levels, components, health.

Loops run on the driver, rows stay on the executors. A round relaxes the edges of the nodes
that got better in the round before, so work shrinks with the frontier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.plans.checkpoint import cut


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, cost, pred) over edges (src, dst, weight >= 0); pred is the least of equal choices.

    sources has the column `source`; several sources are followed at once.
    """
    edges = cut(edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight")))
    known = cut(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")).distinct())
    frontier = known
    while not frontier.isEmpty():
        reached = frontier.withColumnRenamed("node", "src").join(edges, "src").groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("weight")).alias("next"))
        merged = cut(known.join(reached, ["source", "node"], "full").select("source", "node", F.least("cost", "next").alias("cost"), (F.col("next") < F.coalesce("cost", F.lit(float("inf")))).alias("better")))
        known, frontier = merged.select("source", "node", "cost"), merged.where("better").select("source", "node", "cost")
    start = known.select("source", F.col("node").alias("src"), F.col("cost").alias("before"))
    step = start.join(edges, "src").select("source", F.col("dst").alias("node"), "src", (F.col("before") + F.col("weight")).alias("via"))
    tight = step.join(known, ["source", "node"]).where((F.col("via") == F.col("cost")) & (F.col("node") != F.col("source"))).groupBy("source", "node").agg(F.min("src").alias("pred"))
    return known.join(tight, ["source", "node"], "left")


def levels(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, level) by breadth-first search, at most `most` steps away."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("level")).distinct())
    frontier, depth = seen, 0
    while (most is None or depth < most) and not frontier.isEmpty():
        depth += 1
        reached = frontier.select("source", F.col("node").alias("src")).join(edges, "src").select("source", F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen, ["source", "node"], "left_anti").withColumn("level", F.lit(depth)))
        seen = cut(seen.unionByName(frontier))
    return seen


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached when edges go both ways. Labels jump to their label's label."""
    both = edges.select("src", "dst").where("src <> dst")
    both = cut(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        heard = both.join(label.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("heard"))
        lower = label.join(heard, "node", "left").select("node", F.least("component", "heard").alias("next"), "component")
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = cut(lower.join(jump, "next", "left").select("node", F.least("next", "far").alias("now"), "component"))
        changed = moved.where("now <> component").isEmpty()
        label = moved.select("node", F.col("now").alias("component"))
        if changed:
            return label


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, undirected edges, isolated nodes, largest degree and who has it, components."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    every = nodes.select("node").distinct().join(degree, "node", "left").select("node", F.coalesce("count", F.lit(0)).alias("degree"))
    facts = every.agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"), F.max(F.struct("degree", -F.col("node"))).alias("top"))
    parts = components(nodes, edges).agg(F.count_distinct("component").alias("components"))
    return facts.join(pairs.agg(F.count("*").alias("edges"))).join(parts).select("nodes", "edges", "isolated", F.col("top.degree").cast("bigint").alias("max_degree"), (-F.element_at(F.array("top"), 1)["col2"]).alias("max_node"), "components")


def override(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary edges, and secondary ones (src, dst, command) where the primary has no known command for the pair."""
    known = primary.where("command is not null").select("src", "dst").distinct()
    kept = secondary.join(known, ["src", "dst"], "left_anti")
    columns = ["src", "dst", "command"]
    return primary.select(*columns, F.lit("primary").alias("origin")).unionByName(kept.select(*columns, F.lit("secondary").alias("origin")))
