"""Joins and aggregates over rooms, legends, gateways and page links, each over whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import wiki
from loreloom.functions.text import padded, room_tokens, transliterate


def rooms_by_page(rooms: DataFrame) -> DataFrame:
    """(page, rooms): the names of a page's rooms in order of `pos`, repeats included."""
    return rooms.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("rooms"))


def room_index(rooms: DataFrame, grids: DataFrame, gateways: DataFrame) -> DataFrame:
    """(page, name) of all that can be named: rooms, regions, and gateways by label and by an anchor of another name."""
    label = gateways.select("page", F.col("label").alias("name"))
    anchor = gateways.where("anchor is not null and anchor <> label").select("page", F.col("anchor").alias("name"))
    return rooms.select("page", "name").unionByName(grids.select("page", F.col("region").alias("name"))).unionByName(label).unionByName(anchor)


def room_matches(queries: DataFrame, rooms: DataFrame) -> DataFrame:
    """(query_id, page, name, exact): rooms that a form of a query names as a whole or as a run of whole words.

    queries: query_id, form. The first word of the form makes it an equi-join.
    """
    asked = queries.select("query_id", padded("form").alias("f")).where("trim(f) <> ''").withColumn("word", F.element_at(F.split(F.btrim("f"), " "), 1))
    named = rooms.select("page", "name", padded("name").alias("n")).distinct()
    words = named.withColumn("word", F.explode(F.array_distinct(F.split(F.btrim("n"), " "))))
    found = asked.join(words, "word").where(F.contains("n", F.col("f")))
    return found.groupBy("query_id", "page", "name").agg(F.max(F.col("n") == F.col("f")).alias("exact"))


def loose_matches(queries: DataFrame, rooms: DataFrame) -> DataFrame:
    """(query_id, page): pages with a room of which a word equals one of the query."""
    asked = queries.select("query_id", F.explode(room_tokens("form")).alias("word"))
    return asked.join(rooms.select("page", F.explode(room_tokens("name")).alias("word")).distinct(), "word").select("query_id", "page").distinct()


def page_candidates(sources: DataFrame, goals: DataFrame, rooms: DataFrame, hints: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, rank, page, score): pages for a way between two places.

    sources and goals: query_id, form; hints: query_id, hint. A page where an end is matched by
    whole words gets four, by a loose word one, and one where its id has the hint.
    """
    sides = []
    for ends in (sources, goals):
        tight = room_matches(ends, rooms).select("query_id", "page").distinct()
        sides += [tight.withColumn("points", F.lit(4)), loose_matches(ends, rooms).withColumn("points", F.lit(1))]
    points = sides[0]
    for side in sides[1:]:
        points = points.unionByName(side)
    scored = points.groupBy("query_id", "page").agg(F.sum("points").alias("points")).join(hints, "query_id", "left")
    hinted = F.coalesce(F.contains(transliterate("page"), F.col("hint")).cast("int"), F.lit(0))
    scored = scored.select("query_id", "page", (F.col("points") + hinted).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "page"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "page", "score")


def shared_pages(sources: DataFrame, goals: DataFrame) -> DataFrame:
    """(query_id, page) that both ends of a question have."""
    return sources.select("query_id", "page").intersect(goals.select("query_id", "page"))


def reciprocal_links(links: DataFrame) -> DataFrame:
    """(page, room, target, entry): links whose first target links back, with the room that it comes in by.

    links: page, pos, name, targets (an array). Only the first target of a link is beside its page. The entry is the
    link back whose name shares a word with the one that leaves, else the first.
    """
    out = links.select("page", F.col("name").alias("room"), F.col("pos").alias("o"), F.try_element_at("targets", F.lit(1)).alias("target"), room_tokens("name").alias("words")).where("target <> page")
    back = links.select(F.col("page").alias("target"), F.col("name").alias("entry"), F.col("pos").alias("b"), F.explode(F.array_distinct("targets")).alias("page"), room_tokens("name").alias("entry_words"))
    met = out.join(back, ["page", "target"]).withColumn("alike", F.arrays_overlap("words", "entry_words"))
    best = F.row_number().over(Window.partitionBy("page", "room", "o", "target").orderBy(F.desc("alike"), "b"))
    return met.withColumn("n", best).where("n = 1").select("page", "room", "target", "entry").distinct()


def seams(gateways: DataFrame, rooms: DataFrame, least: int = 2) -> DataFrame:
    """(page, gateway, room, shared): for each gateway the room of its page that shares most words with it, at least `least`.

    gateways: page, gateway; rooms: page, pos, name. A word is shared if one contains the other.
    """
    ours = gateways.select("page", "gateway", room_tokens("gateway").alias("words"))
    theirs = rooms.select("page", "pos", "name", room_tokens(F.regexp_replace("name", r"(?s)->.*$", "")).alias("tokens"))
    shared = F.size(F.filter("tokens", lambda t: F.exists("words", lambda w: F.contains(w, t) | F.contains(t, w))))
    met = ours.join(theirs, "page").withColumn("shared", shared).where(F.col("shared") >= least)
    best = F.row_number().over(Window.partitionBy("page", "gateway").orderBy(F.desc("shared"), "pos"))
    return met.withColumn("n", best).where("n = 1").select("page", "gateway", F.col("name").alias("room"), "shared")


def entry_rooms(gateways: DataFrame, rooms: DataFrame) -> DataFrame:
    """(gateway, target, room): the best room of the page that a gateway leads to, by shared words; without any, the gateway's own name."""
    ours = gateways.select("gateway", "target", room_tokens("gateway").alias("words"))
    theirs = rooms.select(F.col("page").alias("target"), "pos", "name", room_tokens("name").alias("tokens"))
    met = ours.join(theirs, "target", "left").withColumn("shared", F.coalesce(F.size(F.array_intersect("words", "tokens")), F.lit(0)))
    best = F.row_number().over(Window.partitionBy("gateway", "target").orderBy(F.desc("shared"), "pos"))
    return met.withColumn("n", best).where("n = 1").select("gateway", "target", F.when(F.col("shared") > 0, F.col("name")).otherwise(F.col("gateway")).alias("room"))


def anchor_uses(rooms: DataFrame) -> DataFrame:
    """(map, anchor, uses, gateway) of rooms' anchors; one used more than three times on a map is terrain, no gateway."""
    used = rooms.select("map", F.explode("anchors").alias("anchor")).groupBy("map", "anchor").agg(F.count("*").alias("uses"))
    return used.withColumn("gateway", F.col("uses") <= 3)


def anchored_maps(anchors: DataFrame, maps: DataFrame) -> DataFrame:
    """(page, anchor, map): the map of a page that an anchor means: the same name, else the same without umlauts, else one that begins with it.

    anchors: page, anchor; maps: page, map (its position), name. The last tier takes four letters or more.
    """
    bare = lambda c: F.regexp_replace(transliterate(c), "[^a-z0-9]+", "")
    met = anchors.join(maps, "page")
    prefix = (F.length(bare("anchor")) >= 4) & F.startswith(bare("name"), bare("anchor"))
    tier = F.when(F.col("anchor") == F.col("name"), 0).when(transliterate("anchor") == transliterate("name"), 1).when(prefix, 2)
    best = F.row_number().over(Window.partitionBy("page", "anchor").orderBy("tier", "map"))
    return met.withColumn("tier", tier).where("tier is not null").withColumn("n", best).where("n = 1").select("page", "anchor", "map")


def name_bridges(rooms: DataFrame) -> DataFrame:
    """(room, target): a room labelled by a letter and the numbered rooms of the same name, if they all are on one other map.

    rooms: page, map, room, label, name.
    """
    key = transliterate("name")
    letter = rooms.where(F.col("label").rlike("^[A-Z]$")).select("page", F.col("map").alias("own"), "room", key.alias("key"))
    number = rooms.where(F.col("label").rlike(r"^\d+$")).select("page", "map", F.col("room").alias("target"), key.alias("key"))
    met = letter.join(number, ["page", "key"]).where("map <> own")
    one = Window.partitionBy("room")
    return met.withColumn("low", F.min("map").over(one)).withColumn("high", F.max("map").over(one)).where("low = high").select("room", "target")


def legend_entries(cells: DataFrame, legend: DataFrame) -> DataFrame:
    """(map, row, col, label, text): each cell's legend entry, by label and colour, else the label's first.

    cells: map, row, col, label, color; legend: map, pos, label, color, text.
    """
    entry = legend.select("map", "label", "pos", F.col("color").alias("entry_color"), "text")
    met = cells.join(entry, ["map", "label"], "left")
    fits = F.coalesce(F.col("color") == F.col("entry_color"), F.lit(False))
    best = F.row_number().over(Window.partitionBy("map", "row", "col").orderBy(F.desc(fits), "pos"))
    return met.withColumn("n", best).where("n = 1").select("map", "row", "col", "label", "text")


def ambiguous_labels(legend: DataFrame) -> DataFrame:
    """(map, label, colors): labels that are drawn in several colours."""
    return legend.groupBy("map", "label").agg(F.countDistinct("color").alias("colors")).where("colors > 1")


def provenance(sources: DataFrame) -> DataFrame:
    """(region, origin, pages): distinct pages that each origin gave a region, in order."""
    return sources.groupBy("region", "origin").agg(F.array_sort(F.collect_set("page")).alias("pages"))


def landmark_pairs(gateways: DataFrame, cells: DataFrame) -> DataFrame:
    """(key, from_col, from_row, to_col, to_row): cells and gateways that name one page; the last gateway and the first cell count.

    gateways: pos, target, col, row; cells: pos, page, col, row.
    """
    key = lambda c: F.regexp_replace(transliterate(F.element_at(F.split(c, "/"), -1)), "[^a-z0-9]+", "")
    ours = gateways.where("target is not null").groupBy(key("target").alias("key")).agg(F.max_by(F.struct("col", "row"), "pos").alias("to"))
    theirs = cells.groupBy(key("page").alias("key")).agg(F.min_by(F.struct("col", "row"), "pos").alias("from"))
    return theirs.join(ours, "key").select("key", F.col("from.col").alias("from_col"), F.col("from.row").alias("from_row"), F.col("to.col").alias("to_col"), F.col("to.row").alias("to_row"))


def paired_by_place(first: DataFrame, second: DataFrame) -> DataFrame:
    """(map, side, ordinal, a, b): entrances of two sources joined by their place along a side. Both: map, side, ordinal, name."""
    return first.select("map", "side", "ordinal", F.col("name").alias("a")).join(second.select("map", "side", "ordinal", F.col("name").alias("b")), ["map", "side", "ordinal"])


def along_edge(points: DataFrame) -> DataFrame:
    """points with `frac`: the place along its side within the map's box, 0 to 1; the middle where the box has no extent. points: map, side, row, col."""
    box = Window.partitionBy("map")
    at = lambda c: F.when(F.max(c).over(box) > F.min(c).over(box), (F.col(c) - F.min(c).over(box)) / (F.max(c).over(box) - F.min(c).over(box))).otherwise(0.5)
    return points.withColumn("frac", F.when(F.col("side").isin("W", "E"), at("row")).otherwise(at("col")))


def nearest_room(crossings: DataFrame, rooms: DataFrame, bonus: float = 0.12) -> DataFrame:
    """(map, side, crossing, room): for every crossing the room of its side that is nearest along the edge; a name that hits counts as `bonus` nearer.

    crossings: map, side, crossing, frac; rooms: map, side, pos, room, frac, hit.
    """
    met = crossings.join(rooms.withColumnRenamed("frac", "room_frac"), ["map", "side"])
    score = F.abs(F.col("room_frac") - F.col("frac")) - F.when(F.col("hit"), bonus).otherwise(0.0)
    best = F.row_number().over(Window.partitionBy("map", "side", "crossing").orderBy(score, "pos"))
    return met.withColumn("n", best).where("n = 1").select("map", "side", "crossing", "room")


def centroids(points: DataFrame, key: str) -> DataFrame:
    """(key, n, row, col): the mean place and the box of each group's points."""
    return points.groupBy(key).agg(F.count("*").alias("n"), F.avg("row").alias("row"), F.avg("col").alias("col"), F.min("row").alias("top"), F.max("row").alias("bottom"), F.min("col").alias("left"), F.max("col").alias("right"))


def run_middles(tiles: DataFrame) -> DataFrame:
    """(map, side, row, col): of each run of adjacent tiles along a side the middle one."""
    axis = F.when(F.col("side").isin("W", "E"), F.col("row")).otherwise(F.col("col"))
    along = Window.partitionBy("map", "side").orderBy("axis", "row", "col")
    begun = tiles.withColumn("axis", axis).withColumn("new", (F.col("axis") - F.lag("axis").over(along) > 1).cast("int"))
    runs = begun.withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(along)).groupBy("map", "side", "run").agg(F.array_sort(F.collect_list(F.struct("axis", "row", "col"))).alias("t"))
    middle = F.element_at("t", (F.floor(F.size("t") / 2) + 1).cast("int"))
    return runs.select("map", "side", middle["row"].alias("row"), middle["col"].alias("col"))


def folded_seams(steps: DataFrame) -> DataFrame:
    """(route, pos, dir, note): steps without a direction give their note to the next step that has none, else the last one to the step before.

    steps: route, pos, dir, note. Notes that wait are joined; a route of notes only keeps them as one step.
    """
    order = Window.partitionBy("route").orderBy("pos")
    seam = F.col("dir").isNull() & F.col("note").isNotNull()
    marked = steps.withColumn("seam", seam).withColumn("group", F.coalesce(F.sum((~seam).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("seam"), F.struct("pos", "note")))), lambda x: x["note"]), "; ")
    waiting = marked.groupBy("route", "group").agg(F.nullif(notes, F.lit("")).alias("waiting"), F.max("pos").alias("last"))
    walked = marked.where("not seam").join(waiting, ["route", "group"], "left").withColumn("note", F.coalesce("note", "waiting"))
    # What waits after the last step.
    ends = walked.groupBy("route").agg(F.max("group").alias("top"))
    left = waiting.join(ends, "route", "left").where("waiting is not null and group > coalesce(top, -1)").select("route", F.col("waiting").alias("rest"), F.col("last").alias("rest_pos"), "top")
    walked = walked.join(left.select("route", "rest", "top"), "route", "left").withColumn("note", F.when((F.col("group") == F.col("top")) & F.col("note").isNull(), F.col("rest")).otherwise(F.col("note")))
    full = walked.where("group = top and rest is not null and note <> rest").select("route").distinct()
    alone = left.where("top is null").unionByName(left.join(full, "route", "left_semi").where("top is not null"))
    extra = alone.select("route", F.col("rest_pos").alias("pos"), F.lit(None).cast("string").alias("dir"), F.col("rest").alias("note"))
    return walked.select("route", "pos", "dir", "note").unionByName(extra)


def cheapest(routes: DataFrame) -> DataFrame:
    """(query_id, seam, cost): of the ways by several last seams the cheapest, the first of equal ones; wet steps cost four more.

    routes: query_id, seam, steps, wet.
    """
    cost = F.col("steps") + 4 * F.col("wet")
    return routes.withColumn("cost", cost).groupBy("query_id").agg(F.min(F.struct("cost", "seam")).alias("best")).select("query_id", "best.seam", "best.cost")


def diagnostics(nodes: DataFrame, edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row a page: nodes, edges, hidden, isolated, max_degree, water_degree, components and suspicion.

    nodes: page, node, name; edges: page, src, dst, hidden, one row a direction; parts: page, node, component.
    """
    pair = edges.select("page", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "hidden")
    pairs = pair.groupBy("page", "a", "b").agg(F.max("hidden").alias("hidden")).groupBy("page").agg(F.count("*").alias("edges"), F.count_if("hidden").alias("hidden"))
    degree = edges.groupBy("page", F.col("src").alias("node")).agg(F.count("*").alias("d"))
    every = nodes.join(degree, ["page", "node"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    water = F.sum(F.when((F.col("d") > 2) & wiki.names_water("name"), F.col("d")).otherwise(0))
    counted = every.groupBy("page").agg(F.count("*").alias("nodes"), F.count_if(F.col("d") == 0).alias("isolated"), F.max("d").alias("max_degree"), water.alias("water_degree"))
    joined = counted.join(pairs, "page", "left").join(parts.groupBy("page").agg(F.countDistinct("component").alias("components")), "page", "left").fillna(0)
    # What each sign of a misread map weighs.
    suspicion = F.col("water_degree") * 4 + F.col("hidden") * 2 + F.col("isolated") * 3 + F.greatest(F.col("components") - 1, F.lit(0)) * 2 + F.greatest(F.col("max_degree") - 4, F.lit(0))
    return joined.withColumn("suspicion", suspicion).select("page", "nodes", "edges", "hidden", "isolated", "max_degree", "water_degree", "components", "suspicion")


def most_suspect(found: DataFrame, most: int = 30) -> DataFrame:
    return found.orderBy(F.desc("suspicion"), "page").limit(most)


def totals(found: DataFrame) -> DataFrame:
    """The sums of diagnostics over all pages."""
    return found.agg(F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in ("nodes", "edges", "hidden", "isolated", "components")), F.count_if(F.col("water_degree") > 0).alias("with_water"))


def gate_words(legend: DataFrame, region: Column | str, longest_noise: int = 4) -> DataFrame:
    """(map, word): words of legends that lead back to a region by land. legend: map, text, color, pages."""
    text = F.regexp_replace("text", r"(?s)\(.*$", "")
    land = legend.where(F.array_contains("pages", region) & ~wiki.borders_water("text") & (F.coalesce("color", F.lit("")) != "0000FF"))
    words = F.filter(F.split(F.lower(text), "[^a-zäöüß]+"), lambda w: F.length(w) > longest_noise)
    return land.select("map", F.explode(words).alias("word")).distinct()


def border_labels(legend: DataFrame, region: Column | str) -> DataFrame:
    """(map, label): labels of one letter whose legend leads back to a region by land. legend: map, label, text, color, pages."""
    land = legend.where(F.array_contains("pages", region) & ~wiki.borders_water("text") & (F.coalesce("color", F.lit("")) != "0000FF"))
    return land.where(wiki.single_glyph("label")).select("map", "label").distinct()


#: A direction, the step to it in rows and columns, and the strokes that join a tile to its neighbour there.
STROKES = [
    ("norden", -1, 0, "|"), ("sueden", 1, 0, "|"), ("westen", 0, -1, "-"), ("osten", 0, 1, "-"),
    ("nordosten", -1, 1, "/X"), ("nordwesten", -1, -1, "\\X"), ("suedwesten", 1, -1, "/X"), ("suedosten", 1, 1, "\\X"),
]


def gate_directions(cells: DataFrame, links: DataFrame, labels: DataFrame, reach: float = 12.0) -> DataFrame:
    """(map, target, row, col, side, blocked): gates near where a map leads to a target, and the directions that no stroke leaves them by.

    cells: map, row, col, glyph, one row a cell; links: map, target, row, col; labels: target, label. Gates are cells
    with a label of the target, at most `reach` from the middle of its links; side is where they lie of that middle.
    """
    middle = links.groupBy("map", "target").agg(F.avg("row").alias("mid_row"), F.avg("col").alias("mid_col"))
    down, across = F.col("row") - F.col("mid_row"), F.col("col") - F.col("mid_col")
    side = F.when(F.abs(across) >= F.abs(down), F.when(across < 0, "W").otherwise("E")).otherwise(F.when(down < 0, "N").otherwise("S"))
    wanted = middle.join(labels.distinct(), "target").withColumnRenamed("label", "glyph")
    gates = cells.join(wanted, ["map", "glyph"]).where(F.sqrt(down * down + across * across) <= reach).select("map", "target", "row", "col", side.alias("side"))
    around = F.array(*(F.struct(F.lit(i).alias("nth"), F.lit(name).alias("name"), (F.col("row") + y).alias("r"), (F.col("col") + x).alias("c"), F.lit(strokes).alias("strokes")) for i, (name, y, x, strokes) in enumerate(STROKES)))
    asked = gates.select("*", F.explode(around).alias("to")).select("map", "target", "row", "col", "side", "to.*")
    beside = cells.select("map", F.col("row").alias("r"), F.col("col").alias("c"), "glyph")
    joined = asked.join(beside, ["map", "r", "c"], "left").withColumn("open", F.coalesce(F.contains("strokes", F.col("glyph")), F.lit(False)))
    shut = F.array_sort(F.collect_list(F.when(~F.col("open"), F.struct("nth", "name"))))
    return joined.groupBy("map", "target", "row", "col", "side").agg(F.transform(shut, lambda x: x["name"]).alias("blocked"))


def portal_pairs(portals: DataFrame) -> DataFrame:
    """(map, target, a, b): rooms that lead from one map to another and back, matched greedily by what their legends share.

    portals: map, room, target, text. A group is one pair of maps; its portals are drawn on them, so that they are few.
    """
    ours = portals.where("map < target").select("map", "target", F.col("room").alias("a"), wiki.landmarks("text").alias("x"))
    theirs = portals.where("map > target").select(F.col("target").alias("map"), F.col("map").alias("target"), F.col("room").alias("b"), wiki.landmarks("text").alias("y"))
    weighed = ours.join(theirs, ["map", "target"]).select("map", "target", "a", "b", wiki.affinity(F.col("x"), F.col("y")).alias("w"))

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(frames)).sort_values(["w", "a", "b"], ascending=[False, True, True])
        used_a, used_b, kept = set(), set(), []
        for row in part.itertuples(index=False):
            if row.a not in used_a and row.b not in used_b:
                used_a.add(row.a)
                used_b.add(row.b)
                kept.append((row.map, row.target, row.a, row.b))
        yield pd.DataFrame(kept, columns=["map", "target", "a", "b"])

    kinds = dict(weighed.dtypes)
    return weighed.groupBy("map", "target").applyInPandas(lambda part: next(match(iter([part]))), ", ".join(f"{c} {kinds[c]}" for c in ("map", "target", "a", "b")))
