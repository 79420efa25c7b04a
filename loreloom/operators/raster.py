"""Tile maps in long form: terrain by colour, road continuity, footprints, and walking routes."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost of a step on each terrain.
COSTS = {"road": 1, "grass": 3, "forest": 3, "rock": 4, "sand": 3, "water": 5, "ocean": 10, "other": 3}
WET = ("water", "ocean")
SWIM = 3
DROWN = 1000
ROAD_DISCOUNT = 0.1
OFFSETS = {"N": (-1, 0), "S": (1, 0), "E": (0, 1), "W": (0, -1), "NE": (-1, 1), "NW": (-1, -1), "SE": (1, 1), "SW": (1, -1)}


def terrain(r: Column, g: Column, b: Column) -> Column:
    """Terrain of a colour; the first rule that fits counts."""
    # The thresholds of the rules.
    return (
        F.when((r < 40) & (g < 40) & (b < 40), "ocean")
        .when((b > 150) & (r < 110), "water")
        .when((r > 180) & (g > 140) & (b < g - 40), "sand")
        .when((r > 90) & (g > 30) & (g < 150) & (b < 70) & (r > g + 40), "road")
        .when((r > 150) & (g > 150) & (b > 150), "rock")
        .when((g > r) & (g > b), F.when(g < 140, "forest").otherwise("grass"))
        .otherwise("other")
    )


def cost_of(kind: Column) -> Column:
    out = F.lit(COSTS["other"])
    for name, cost in COSTS.items():
        out = F.when(kind == name, cost).otherwise(out)
    return out


def road_continuity(tiles: DataFrame) -> DataFrame:
    """Road tiles without a road among their eight neighbours go back to their `base` terrain."""
    road = tiles.where("terrain = 'road'").select("region", "row", "col")
    around = F.explode(F.expr("flatten(transform(array(-1, 0, 1), a -> transform(array(-1, 0, 1), b -> named_struct('a', a, 'b', b))))"))
    near = road.select("region", "row", "col", around.alias("d")).where("d.a <> 0 or d.b <> 0").select("region", (F.col("row") + F.col("d.a")).alias("row"), (F.col("col") + F.col("d.b")).alias("col")).distinct().withColumn("linked", F.lit(True))
    joined = tiles.join(near, ["region", "row", "col"], "left")
    return joined.withColumn("terrain", F.when((F.col("terrain") == "road") & F.col("linked").isNull(), F.col("base")).otherwise(F.col("terrain"))).drop("linked")


def footprints(rects: DataFrame, size: int = 12) -> DataFrame:
    """(label, row, col) of all tiles that a pixel box covers."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return rects.select("label", "x1", "x2", span("y1", "y2").alias("row")).select("label", "row", span("x1", "x2").alias("col"))


def _walk(tiles: pd.DataFrame, start: tuple[int, int], goal: tuple[int, int], costs: dict[str, int]) -> tuple[float | None, list[tuple[int, int]]]:
    kind = {(r, c): t for r, c, t in zip(tiles["row"], tiles["col"], tiles["terrain"], strict=True)}
    shut = {(r, c) for r, c, x in zip(tiles["row"], tiles["col"], tiles["blocked"], strict=True) if x}
    # Directions in which a tile's road leaves it, where the table has them; else a road goes to every road beside it.
    leads = {} if "road_dirs" not in tiles else {(r, c): {OFFSETS[d]: True for d in x} for r, c, x in zip(tiles["row"], tiles["col"], tiles["road_dirs"], strict=True) if x is not None}
    open_ = lambda p: p in kind and p not in shut
    first = (*start, 0)
    best, came, heap = {first: 0.0}, {}, [(0.0, first)]
    while heap:
        cost, state = heapq.heappop(heap)
        if cost > best[state]:
            continue
        row, col, run = state
        if (row, col) == goal:
            path = [state]
            while path[-1] in came:
                path.append(came[path[-1]])
            return cost, [(r, c) for r, c, _ in reversed(path)]
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                to = (row + dr, col + dc)
                if (dr, dc) == (0, 0) or not open_(to) or dr and dc and ((row + dr, col) in shut or (row, col + dc) in shut):
                    continue
                wet = min(run + 1, SWIM + 1) if kind[to] in WET else 0
                step = costs[kind[to]] + DROWN * (wet > SWIM)
                if leads.get((row, col), {}).get((dr, dc)) or not leads and kind[to] == kind[row, col] == "road":
                    step -= ROAD_DISCOUNT
                state2 = (*to, wet)
                if cost + step < best.get(state2, float("inf")):
                    best[state2], came[state2] = cost + step, state
                    heapq.heappush(heap, (cost + step, state2))
    return None, []


def routes(tiles: DataFrame, costs: dict[str, int] | None = None) -> DataFrame:
    """(region, ok, cost, path) for tiles with from_row, from_col, to_row and to_col on every row of a region.

    A region is one group: maps are drawn by hand and of bounded size; regions run in parallel.
    """
    costs = costs or COSTS

    def run(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        cost, path = _walk(part, (one.from_row, one.from_col), (one.to_row, one.to_col), costs)
        return pd.DataFrame({"region": [one.region], "ok": [cost is not None], "cost": [cost], "path": [[f"{r},{c}" for r, c in path]]})

    return tiles.groupBy("region").applyInPandas(run, "region string, ok boolean, cost double, path array<string>")


def drawn(tiles: DataFrame) -> DataFrame:
    """(region, row, line): a glyph for each tile."""
    glyph = F.create_map(*(F.lit(x) for pair in {"road": "=", "grass": ".", "forest": ",", "rock": "^", "sand": ":", "water": "~", "ocean": " ", "other": "?"}.items() for x in pair))
    cells = F.array_sort(F.collect_list(F.struct("col", glyph[F.col("terrain")].alias("g"))))
    return tiles.groupBy("region", "row").agg(F.array_join(F.transform(cells, lambda x: x["g"]), "").alias("line"))
