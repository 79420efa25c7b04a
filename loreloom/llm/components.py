"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins on tables that were written to the shared
scratch folder, so that adaptive execution can split the join of a vertex with very many
neighbours. The number of rounds grows with the logarithm of the longest chain. A graph of at most
`WHOLE` edges between integers needs none of them: one task of an executor joins its trees.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.scratch import Scratch

#: Edges, some 20 MB, that one task takes at most; all others go through the rounds.
WHOLE = 1 << 17


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of every node of the edges (a, b), which are a whole graph."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([top(x) for x in up], kind)], names=["node", "root"])


def _star(edges: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    joined = both.join(low, "a")
    if large:  # repeated edges do no harm before the small star
        return scratch.cut(joined.where("b > a").select(F.col("b").alias("a"), F.least("low", "a").alias("b")), "star")
    out = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return scratch.cut(out.distinct(), "star")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an edge between two nodes, the smallest node that it reaches.

    Loops, repeated and reversed edges and edges with a null end are fine; they add nothing.
    """
    kind = dict(edges.dtypes)[a]
    edges = scratch.cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").select(F.col("a").cast(kind), F.col("b").cast(kind)), "edges")
    if kind in ("tinyint", "smallint", "int", "bigint") and edges.count() <= WHOLE:
        return scratch.cut(edges.coalesce(1).mapInArrow(_trees, f"node {kind}, root {kind}"), "roots")
    now = scratch.cut(edges.distinct(), "edges")
    scratch.drop(edges)
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        wide = _star(now, scratch, True)
        scratch.drop(now)
        now = _star(wide, scratch, False)
        scratch.drop(wide)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
