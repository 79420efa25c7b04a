"""Tile maps built from pixels and image maps: classes of tiles, origin, gateways and tiles by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.text import padded, slug
from loreloom.operators.raster import cost_of, road_continuity, terrain

SIZE = 12
#: Pixels of a tile's border that belong to a direction.
BAND = 3


def origin(rects: DataFrame) -> DataFrame:
    """(region, origin): where the tiles of a region begin: the commonest remainder of the corners of one-tile boxes, if it is 0 or 1; else 0.

    rects: region, pos, x1, y1, x2, y2. Of equally common remainders the one met first counts.
    """
    small = rects.where((F.col("x2") - F.col("x1") <= SIZE) & (F.col("y2") - F.col("y1") <= SIZE))
    votes = small.select("region", "pos", F.posexplode(F.array(F.col("x1") % SIZE, F.col("y1") % SIZE)).alias("axis", "v"))
    counted = votes.groupBy("region", "v").agg(F.count("*").alias("n"), F.min(F.struct("pos", "axis")).alias("first"))
    best = F.row_number().over(Window.partitionBy("region").orderBy(F.desc("n"), "first"))
    voted = counted.withColumn("r", best).where("r = 1").select("region", F.when(F.col("v") <= 1, F.col("v")).otherwise(0).alias("origin"))
    return rects.select("region").distinct().join(voted, "region", "left").select("region", F.coalesce("origin", F.lit(0)).cast("int").alias("origin"))


def scaled(rects: DataFrame, pictures: DataFrame) -> DataFrame:
    """rects in pixels of the picture, where they were written against another width. pictures: region, width, height, shown (null: as it is)."""
    factor = F.when(F.col("shown").isNotNull() & (F.col("shown") != F.col("width")), F.col("width") / F.col("shown")).otherwise(1.0)
    joined = rects.join(pictures.select("region", factor.alias("f")), "region")
    return joined.select(*(F.floor(F.col(c) * F.col("f") + 0.5).cast("int").alias(c) if c in ("x1", "y1", "x2", "y2") else F.col(c) for c in rects.columns))


def classes(pixels: DataFrame, origins: DataFrame) -> DataFrame:
    """(region, row, col, terrain, base, road_dirs) of every whole tile.

    pixels: region, x, y, r, g, b. The base is the commonest terrain but ocean, of equals the one met first;
    a tile almost all ocean is ocean; one crossed by a stroke, dark or brown, is road, in the
    directions of the border that the stroke touches.
    """
    at = pixels.join(origins, "region").withColumn("px", F.col("x") - F.col("origin")).withColumn("py", F.col("y") - F.col("origin")).where("px >= 0 and py >= 0")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    # Colours of a stroke.
    stroke = ((r < 60) & (g < 60) & (b < 60)) | ((r > 90) & (g > 30) & (g < 150) & (b < 70) & (r > g + 40))
    tile = at.select("region", F.floor(F.col("py") / SIZE).cast("int").alias("row"), F.floor(F.col("px") / SIZE).cast("int").alias("col"), (F.col("py") % SIZE).alias("v"), (F.col("px") % SIZE).alias("u"), terrain(r, g, b).alias("kind"), stroke.alias("stroke"))
    top, bottom, left, right = F.col("v") < BAND, F.col("v") >= SIZE - BAND, F.col("u") < BAND, F.col("u") >= SIZE - BAND
    side = F.when(top & left, "NW").when(top & right, "NE").when(bottom & left, "SW").when(bottom & right, "SE").when(top, "N").when(bottom, "S").when(left, "W").when(right, "E")
    # One pass by kind, then one by tile, so that pixels are combined before they are shuffled.
    kinds = tile.groupBy("region", "row", "col", "kind").agg(F.count("*").alias("n"), F.min(F.col("v") * SIZE + F.col("u")).alias("first"), F.count_if("stroke").alias("strokes"), F.collect_set(F.when(F.col("stroke"), side)).alias("sides"))
    total, share = F.sum("n"), SIZE * SIZE
    summed = kinds.groupBy("region", "row", "col").agg(
        total.alias("pixels"),
        F.sum(F.when(F.col("kind") == "ocean", F.col("n")).otherwise(0)).alias("sea"),
        F.sum("strokes").alias("strokes"),
        F.max(F.when(F.col("kind") != "ocean", F.struct("n", (-F.col("first")).alias("o"), "kind")))["kind"].alias("base"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sides")))).alias("sides"),
    ).where(F.col("pixels") == share)
    none = F.array().cast("array<string>")
    # The shares of sea and of strokes.
    sea = F.col("sea") / share > 0.85
    dirs = F.when(~sea & (F.col("strokes") / share > 0.08) & (F.col("strokes") / share < 0.75), F.col("sides")).otherwise(none)
    base = F.when(sea, "ocean").otherwise(F.coalesce("base", F.lit("grass")))
    return summed.select("region", "row", "col", F.when(F.size(dirs) > 0, "road").otherwise(base).alias("terrain"), base.alias("base"), dirs.alias("road_dirs"))


def grid(pixels: DataFrame, rects: DataFrame) -> DataFrame:
    """(region, row, col, terrain, base, road_dirs, cost): classes whose lone road tiles have gone back to their base."""
    kept = road_continuity(classes(pixels, origin(rects)))
    road = F.when(F.col("terrain") == "road", F.col("road_dirs")).otherwise(F.array().cast("array<string>"))
    return kept.withColumn("road_dirs", road).withColumn("cost", cost_of(F.col("terrain")))


def extents(pictures: DataFrame, origins: DataFrame) -> DataFrame:
    """(region, page, origin, cols, rows) of every picture."""
    count = lambda c: F.floor((F.col(c) - F.col("origin")) / SIZE).cast("int")
    return pictures.join(origins, "region").select("region", F.concat(F.lit("karte/"), slug("region")).alias("page"), "origin", count("width").alias("cols"), count("height").alias("rows"))


def gateways(rects: DataFrame, sizes: DataFrame) -> DataFrame:
    """(region, pos, row, col, target, anchor, label): the tile in the middle of every box of at most three tiles, kept inside the map."""
    small = rects.where((F.col("x2") - F.col("x1") <= 3 * SIZE) & (F.col("y2") - F.col("y1") <= 3 * SIZE)).join(sizes, "region")
    inside = lambda a, b, n: F.least(F.col(n) - 1, F.greatest(F.lit(0), F.floor(((F.col(a) + F.col(b)) / 2 - F.col("origin")) / SIZE))).cast("int")
    return small.select("region", "pos", inside("y1", "y2", "rows").alias("row"), inside("x1", "x2", "cols").alias("col"), "target", "anchor", "label")


def areas(rects: DataFrame, sizes: DataFrame) -> DataFrame:
    """(region, target, top, left, bottom, right): tiles that boxes with a target cover, where they are more than one tile."""
    large = rects.where(F.col("target").isNotNull() & ~((F.col("x2") - F.col("x1") <= SIZE) & (F.col("y2") - F.col("y1") <= SIZE))).join(sizes, "region")
    inside = lambda c, n: F.least(F.col(n) - 1, F.greatest(F.lit(0), F.floor((F.col(c) - F.col("origin")) / SIZE))).cast("int")
    return large.select("region", "target", inside("y1", "rows").alias("top"), inside("x1", "cols").alias("left"), inside("y2", "rows").alias("bottom"), inside("x2", "cols").alias("right"))


def resolve_tiles(queries: DataFrame, gates: DataFrame, tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_id, rank, row, col, name): the tiles that a query names in its region, rank 1 first; several gateways may score the best.

    queries: query_id, region, text. A query is "col,row", or a gateway by its label or its target's page
    (5 the same, 4 a target within it or the other way, 3 a label so), else the region, for which
    the cheapest tile near the middle stands. gates, tiles and sizes: of gateways, grid and extents.
    """
    pair = r"^\s*(\d+)\s*[,;]\s*(\d+)\s*$"
    direct = queries.where(F.col("text").rlike(pair)).select("query_id", F.lit(1).alias("rank"), F.regexp_extract("text", pair, 2).cast("int").alias("row"), F.regexp_extract("text", pair, 1).cast("int").alias("col"))
    direct = direct.withColumn("name", F.concat_ws(",", "col", "row"))
    named = queries.where(~F.col("text").rlike(pair)).select("query_id", "region", padded("text").alias("q"))
    gate = gates.select("region", "pos", "row", "col", "label", padded("label").alias("l"), padded(F.element_at(F.split("target", "/"), -1)).alias("t"))
    q, label, target = F.col("q"), F.col("l"), F.col("t")
    by_label = F.when(label == q, 5).when(F.contains(label, q) | F.contains(q, label), 3).otherwise(0)
    by_target = F.when(target == q, 5).when(F.contains(q, target) | F.contains(target, q), 4).otherwise(0)
    scored = named.join(gate, "region").withColumn("score", F.greatest(by_label, by_target)).where("score > 0")
    top = scored.withColumn("best", F.max("score").over(Window.partitionBy("query_id"))).where("score = best")
    order = Window.partitionBy("query_id").orderBy("pos")
    by_gate = top.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "row", "col", F.col("label").alias("name"))
    rest = named.join(by_gate, "query_id", "left_anti").where(F.contains("q", padded("region")))
    distance = F.abs(F.col("col") - F.col("cols") / 2) + F.abs(F.col("row") - F.col("rows") / 2) + 2 * F.col("cost")
    middle = tiles.where("terrain <> 'ocean'").join(sizes.select("region", "cols", "rows"), "region").groupBy("region").agg(F.min(F.struct(distance.alias("d"), "row", "col")).alias("m"))
    by_region = rest.join(middle, "region").select("query_id", F.lit(1).alias("rank"), "m.row", "m.col", F.col("region").alias("name"))
    return direct.unionByName(by_gate).unionByName(by_region)
