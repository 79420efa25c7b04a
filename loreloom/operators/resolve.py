"""Names resolved to nodes: strict resolution of one name, and reconciliation of two sources.

Two sources describe the same rooms. Bindings come in tiers: a shared portal, a name that is
unique on both sides, then passes of a distinctive word and of two shared neighbours. Tiers
and passes are joins over the whole graph; what a pass binds, the next one sees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions.text import normal, room_tokens, tokens_overlap
from loreloom.plans.checkpoint import cut

PASSES = 4
DISTINCTIVE = 5
#: Costs of a unified edge: a passage between maps, its source, and what is unknown about it.
TRANSITION, SECONDARY, HINTED, BARE = 3, 2, 1, 2


def base_name(name: Column) -> Column:
    """A name without what stands in brackets."""
    return normal(F.regexp_replace(name, r"\([^)]*\)", ""))


def resolve(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query, id, name): the exact base name, else a node that has every word of the query.

    queries: query. nodes: id, name, origin (`primary` first). Queries under three characters and
    those whose words are not all there get nothing; ties go to the primary source, then the
    shortest name, then the id. Words make the second tier an equi-join.
    """
    asked = queries.select("query", base_name(F.col("query")).alias("q"), room_tokens("query").alias("words")).where(F.length("q") >= 3)
    named = nodes.where("name is not null").select("id", "name", "origin", base_name(F.col("name")).alias("n"))
    exact = asked.join(named, F.col("q") == F.col("n")).select("query", "id", "name", "origin", F.lit(0).alias("tier"))
    # A word of a name may contain that of the query; their shared first three letters make it an equi-join.
    word = named.select("id", "name", "origin", F.explode(room_tokens("name")).alias("long"))
    places = F.sequence(F.lit(1), F.length("long") - 2)
    word = word.withColumn("start", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("long"), i, F.lit(3))))))
    found = asked.select("query", F.size("words").alias("need"), F.explode("words").alias("word")).withColumn("start", F.substring("word", 1, 3)).join(word, "start").where(F.contains("long", "word"))
    every = found.groupBy("query", "id", "name", "origin", "need").agg(F.countDistinct("word").alias("have")).where("have = need").select("query", "id", "name", "origin", F.lit(1).alias("tier"))
    order = Window.partitionBy("query").orderBy("tier", (F.col("origin") != "primary").cast("int"), F.length("name"), "id")
    return exact.unionByName(every).withColumn("rank", F.row_number().over(order)).where("rank = 1").select("query", "id", "name")


def _single(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) in which both sides have one partner only."""
    a, b = Window.partitionBy("a"), Window.partitionBy("b")
    return pairs.distinct().withColumn("na", F.count("*").over(a)).withColumn("nb", F.count("*").over(b)).where("na = 1 and nb = 1").select("a", "b")


def _free(pairs: DataFrame, bound: DataFrame) -> DataFrame:
    return pairs.join(bound.select("a"), "a", "left_anti").join(bound.select("b"), "b", "left_anti")


def reconcile(primary: DataFrame, secondary: DataFrame, primary_edges: DataFrame, secondary_edges: DataFrame) -> DataFrame:
    """(a, b, tier): which primary node a each secondary node b is. Nodes: id, name, portals; edges: src, dst."""
    p = primary.select(F.col("id").alias("a"), "name", "portals")
    s = secondary.select(F.col("id").alias("b"), "name", "portals")
    portal = _single(p.select("a", F.explode("portals").alias("x")).join(s.select("b", F.explode("portals").alias("x")), "x").select("a", "b"))
    bound = cut(portal.withColumn("tier", F.lit("portal")))
    same = p.select("a", base_name(F.col("name")).alias("n")).where("n <> ''").join(s.select("b", base_name(F.col("name")).alias("n")), "n").select("a", "b")
    bound = cut(bound.unionByName(_free(_single(same), bound).withColumn("tier", F.lit("name"))))
    stem = lambda side, key: side.select(key, F.explode(F.filter(room_tokens("name"), lambda w: F.length(w) >= DISTINCTIVE)).alias(f"{key}_word")).withColumn("stem", F.substring(f"{key}_word", 1, DISTINCTIVE))
    alike = stem(p, "a").join(stem(s, "b"), "stem").where(F.startswith("a_word", F.col("b_word")) | F.startswith("b_word", F.col("a_word")))
    # A word of a secondary room that fits one primary room only is distinctive.
    fits = cut(alike.select("a", "b", "b_word").distinct().withColumn("n", F.count("*").over(Window.partitionBy("b", "b_word"))).where("n = 1").select("a", "b").distinct())
    words_of = lambda side, key: side.select(key, room_tokens("name").alias(f"{key}_words"))
    both = lambda e, x, y: e.select(F.col("src").alias(x), F.col("dst").alias(y)).unionByName(e.select(F.col("dst").alias(x), F.col("src").alias(y))).distinct()
    pe, se = cut(both(primary_edges, "a", "a2")), cut(both(secondary_edges, "b", "b2"))
    for _ in range(PASSES):
        named = _single(_free(fits, bound)).withColumn("tier", F.lit("word"))
        known = bound.select(F.col("a").alias("a2"), F.col("b").alias("b2"))
        shared = known.join(pe, "a2").join(se, "b2").groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2")
        best = Window.partitionBy("b").orderBy(F.desc("n"))
        leading = shared.withColumn("r", F.rank().over(best)).where("r = 1").select("a", "b")
        # Rooms that both have a name share a word of it.
        guarded = leading.join(words_of(p, "a"), "a").join(words_of(s, "b"), "b").where(F.expr("coalesce(size(a_words), 0) <= 0 or coalesce(size(b_words), 0) <= 0") | tokens_overlap(F.col("a_words"), F.col("b_words"))).select("a", "b")
        near = _free(_single(guarded), bound).withColumn("tier", F.lit("neighbours"))
        new = cut(named.unionByName(near.join(named.select("a"), "a", "left_anti").join(named.select("b"), "b", "left_anti")))
        if new.isEmpty():
            break
        bound = cut(bound.unionByName(new))
    return bound


def merge(primary_edges: DataFrame, secondary_edges: DataFrame, bound: DataFrame) -> DataFrame:
    """(src, dst, command, hint, transition, origin, weight): all primary edges, and what secondary ones add.

    A secondary edge is left out where its rooms became one, where the primary source knows the command,
    where neither knows it and there is no hint, and where another one, earlier by command and
    hint, joins the same rooms that the primary source doesn't join at all.
    """
    columns = ["src", "dst", "command", "hint", "transition"]
    name = bound.select(F.col("b").alias("key"), F.col("a").alias("to"))
    moved = secondary_edges.join(name.withColumnRenamed("key", "src").withColumnRenamed("to", "s"), "src", "left").join(name.withColumnRenamed("key", "dst").withColumnRenamed("to", "d"), "dst", "left")
    moved = moved.select(F.coalesce("s", "src").alias("src"), F.coalesce("d", "dst").alias("dst"), "command", "hint", "transition").where("src <> dst")
    stated = primary_edges.groupBy("src", "dst").agg(F.max(F.col("command").isNotNull()).alias("known"))
    first = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.col("command").asc_nulls_last(), F.col("hint").asc_nulls_last()))
    judged = moved.join(stated, ["src", "dst"], "left").withColumn("nth", first)
    adds = F.when(F.col("known").isNull(), F.col("nth") == 1).otherwise(~F.col("known") & (F.col("command").isNotNull() | F.col("hint").isNotNull()))
    kept = judged.where(adds)
    all_ = primary_edges.select(*columns, F.lit("primary").alias("origin")).unionByName(kept.select(*columns, F.lit("secondary").alias("origin")))
    unknown = F.when(F.col("transition") | F.col("command").isNotNull(), 0).when(F.col("hint").isNotNull(), HINTED).otherwise(BARE)
    return all_.withColumn("weight", (F.when(F.col("transition"), TRANSITION).otherwise(0) + F.when(F.col("origin") == "secondary", SECONDARY).otherwise(1) + unknown).cast("double"))
