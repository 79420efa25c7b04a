"""Sharding by balanced label propagation.

Linked documents move towards the shards of their neighbours, in rounds of joins. A shard
admits newcomers only up to its quota of linked documents; beyond that a share of the
candidates gets in, chosen by the hash of their smallest neighbour so that groups move as
one. Afterwards one range sort by (shard, anchor, id) lines all documents up, and the line
is cut into shards whose sizes differ by one at most, so that groups which ended up
together are cut at the few borders only.

All law here is `rows`: counts at most one apart. Nothing about single documents reaches
the driver; it sees a count for each pair of shards and for each partition of the sort.

Defined cases: a null text links with nothing and has size 8 and the checksum of no bytes;
repeated rows count as documents of their own; an empty table gives no rows; fewer
documents than shards leave shards empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.scratch import Scratch

ROUNDS = 6


def propagate(nodes: DataFrame, edges: DataFrame, n_shards: int, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(node, shard, anchor) for all nodes; anchor is a linked node's smallest neighbour or itself.

    nodes has unique longs in `node`; edges has `src` and `dst`, one row a link, any direction.
    """
    start = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(n_shards)).cast("int")
    both = edges.select("src", "dst").where("src <> dst")
    both = scratch.cut(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    quota = -(-nodes.count() // n_shards)
    anchors = both.groupBy("src").agg(F.min("dst").alias("least"))
    state = scratch.cut(anchors.select(F.col("src").alias("node"), F.least("src", "least").alias("anchor")).withColumn("shard", start), "state")
    for round_ in range(rounds):
        # Neighbours with smaller ids lead in even rounds; in odd rounds all do, for half of the nodes, lest pairs swap for ever.
        led = both.where("dst < src") if round_ % 2 == 0 else both.where(F.pmod(F.xxhash64("src", F.lit(round_)), F.lit(2)) == 0)
        votes = led.join(state.select(F.col("node").alias("dst"), "shard"), "dst").groupBy("src", "shard").count()
        best = votes.groupBy("src").agg(F.max(F.struct("count", F.xxhash64("src", "shard").alias("tie"), "shard")).alias("best")).select(F.col("src").alias("node"), F.col("best.shard").alias("target"))
        wish = scratch.cut(state.join(best, "node", "left"), "wish")
        load = {r[0]: r[1] for r in wish.groupBy("shard").count().collect()}
        flow = {(r[0], r[1]): r[2] for r in wish.where("target <> shard").groupBy("shard", "target").count().collect()}
        if not flow:
            break
        admitted = _admissions(flow, load, quota, n_shards)
        share = F.create_map(*(F.lit(x) for s, a in enumerate(admitted) for x in (s, a)))
        luck = F.pmod(F.xxhash64("anchor", F.lit(100 + round_)), F.lit(1 << 30)) / float(1 << 30)
        moved = F.when((F.col("target") != F.col("shard")) & (luck < share[F.col("target")]), F.col("target")).otherwise(F.col("shard"))
        old, state = state, scratch.cut(wish.select("node", "anchor", moved.alias("shard")), "state")
        scratch.drop(old)
        scratch.drop(wish)
    return nodes.select("node").join(state, "node", "left").select("node", F.coalesce("shard", start).alias("shard"), F.coalesce("anchor", "node").alias("anchor"))


def _admissions(flow: dict[tuple[int, int], int], load: dict[int, int], quota: int, n_shards: int) -> list[float]:
    """The share of candidates that each shard lets in: its room plus what leaves it, where leaving needs to be let in elsewhere."""
    moves = np.zeros((n_shards, n_shards))
    for (source, target), n in flow.items():
        moves[source, target] = n
    room = quota - np.array([load.get(s, 0) for s in range(n_shards)])
    demand, share = np.maximum(moves.sum(0), 1), np.ones(n_shards)
    for _ in range(100):
        share = np.clip((room + moves @ share) / demand, 0, 1)
    return share.tolist()


def positions(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """df with `position`, its 0-based rank in the order, by a range sort and a prefix sum over partitions."""
    lined = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    lined = scratch.cut(lined, "lined")
    part = F.shiftright("__at", 33)
    offset, starts = 0, []
    for p, n in sorted((r[0], r[1]) for r in lined.groupBy(part.alias("p")).count().collect()):
        starts.append((p, offset))
        offset += n
    if not starts:
        return lined.withColumn("position", F.col("__at")).drop("__at")
    begin = df.sparkSession.createDataFrame(starts, "__part bigint, __begin bigint")
    return lined.withColumn("__part", part).join(F.broadcast(begin), "__part").withColumn("position", F.col("__begin") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__begin")


def shard_documents(docs: DataFrame, n_shards: int = 24, *, key: str = "doc_id", text: str = "text", links: DataFrame | None = None) -> DataFrame:
    """key, size, text_crc32, shard and slot of every row. links: (src, dst) of linked keys; equal texts where it is None."""
    scratch = Scratch(docs.sparkSession, "sharding")
    facts = docs.select(F.col(key).alias("key"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"), F.crc32(F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))).cast("bigint").alias("text_crc32"), F.sha2(text, 256).alias("same"))
    facts = scratch.cut(facts.withColumn("node", F.monotonically_increasing_id()), "facts")
    if links is None:
        # A group that no shard can hold is dealt into parts that fit; each part has a hub of its own.
        quota = max(1, facts.count() // n_shards)
        sizes = scratch.cut(facts.where("same is not null").groupBy("same").count().where("count > 1"), "sizes")
        parts = F.when(F.col("count") > quota, F.floor(F.col("position") / quota)).otherwise(F.lit(0))
        members = scratch.cut(positions(facts.join(sizes, "same").select("same", "node", "count"), ["same", "node"], scratch).select("same", "node", parts.alias("part")), "members")
        hubs = scratch.cut(members.groupBy("same", "part").agg(F.min("node").alias("dst")), "hubs")
        edges = members.join(hubs, ["same", "part"]).select(F.col("node").alias("src"), "dst")
    else:
        ids = facts.groupBy("key").agg(F.min("node").alias("node"))
        edges = links.join(ids.select(F.col("key").alias("src"), F.col("node").alias("a")), "src").join(ids.select(F.col("key").alias("dst"), F.col("node").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    where = propagate(facts, edges, n_shards, scratch)
    lined = positions(facts.drop("same").join(where, "node"), ["shard", "anchor", "node"], scratch)
    least, more = divmod(facts.count(), n_shards)
    wide = more * (least + 1)
    at = F.col("position")
    cut = F.when(at < wide, F.floor(at / (least + 1))).otherwise(more + F.floor((at - wide) / max(1, least)))
    begin = F.when(F.col("shard") < more, F.col("shard") * (least + 1)).otherwise(wide + (F.col("shard") - more) * least)
    return lined.withColumn("shard", cut.cast("int")).select(F.col("key").alias(key), "size", "text_crc32", "shard", (at - begin).cast("bigint").alias("slot"))
