"""MinHash near-dedup by a chosen-path set similarity join.

Documents are sets of word shingles. Documents with the same set are one representative from
the start. Every representative enters `TREES` independent trees. Its path in a tree is a
sequence of minwise tokens; those that share the first `STEP` tokens meet in a root node. A
node that is small is compared exhaustively; a large one branches by `STEP` more tokens of its
members, again and again, until every node is small. A member follows one path in a tree, so
a level never holds more rows than the level before, however alike the members are.

Only connections matter for the result, so the work follows them, in two passes:

1. The root nodes of `FIRST` trees. Large ones are dealt into chunks of at most `NODE` members,
   and each chunk also gets the node's medoid, the member most like the commonest signature.
   A hot group of near copies is connected here through its medoid, whatever its size.
2. The nodes of all trees whose members aren't one component yet, branched until they're small.

A node is small with at most `ITEMS` shingles and as many pairs of different components as `NODE`
members can have, so that the rest of a hot group that is mostly connected isn't branched on and
on for a few members; `WIDE` members are the most. Its members' signatures (256
minwise values, 8 bits each) are compared across components, with a margin of four standard
deviations below the threshold. Members that are like no other are done; the sets of the others
are sent to the node, once for each member and never for each pair, and pairs are confirmed on the
full sets, the likeliest first, until what can be linked is one component. A node reports the
links that connect it, fewer than its members.

Nothing is capped: a pair at the threshold that shares no root misses each other with probability
(1 - 0.8 ** 2) ** TREES, 5e-6. Where a node branched d times, a tree still holds the pair with
probability 0.8 ** (2 + 2 d); in a hot group a document has many partners, and one suffices.

Defined cases: a document without words or with a null text has the empty set, links with
nothing and keeps itself; with fewer words than a shingle the whole sequence is the one
shingle; a very long text is one set like any other, and its node branches earlier; ties don't
arise, since the least id names a component; repeated rows and equal ids share their fate; rows
with a null id link with nothing and have a null component; an empty table gives no rows.
Columns other than key and text aren't read, so their names may clash with results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm import textscan as ts
from loreloom.llm.components import components
from loreloom.llm.scratch import Scratch

TREES, STEP, FIRST = 12, 2, 2
SLOTS = 256
NODE, WIDE, ITEMS = 512, 2048, 4 << 20
#: All slots of a signature have been branched by then.
DEPTH = SLOTS // STEP
#: The filter of ids has 16 bits for each that is looked for, up to 64 MB.
MAX_FILTER_BITS = 1 << 29


def shingle_sets(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes in order, row after row, and where each row's begin."""
    w = ts.words(column, ts.NON_SPACE)
    count = np.diff(w.first)
    h, at = ts.windows(w, n)
    row = np.searchsorted(w.first, at, "right") - 1
    for short in range(1, n):
        if (count == short).any():
            hs, pos = ts.windows(w, short)
            owner = np.searchsorted(w.first, pos, "right") - 1
            mine = count[owner] == short
            h, row = np.concatenate([h, hs[mine]]), np.concatenate([row, owner[mine]])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(count) + 1))


def _factors() -> np.ndarray:
    return ts.mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)


def _fingerprints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums for each row; rows must not be empty."""
    return np.add.reduceat(ts.mix(h), first).view(np.int64), np.add.reduceat(ts.mix(h ^ np.uint64(0x5851F42D4C957F2D)), first).view(np.int64)


def _roots(low: np.ndarray) -> np.ndarray:
    """The root of every row in every tree: a hash of the tree and of the first tokens of the path."""
    keys = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(low), 1))
    for step in range(STEP):
        keys = ts.mix(keys ^ low[:, step : TREES * STEP : STEP])
    return keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch], key: str, text: str, n: int) -> Iterator[pa.RecordBatch]:
    factors = _factors()
    for batch in ts.slices(batches, text):
        h, first = shingle_sets(batch.column(text), n)
        size = np.diff(first)
        some = np.flatnonzero(size)
        at = first[:-1][some]
        low = np.empty((len(some), SLOTS), np.uint64)
        for k in range(SLOTS if len(some) else 0):
            low[:, k] = np.minimum.reduceat(h * factors[k], at)
        signature = (ts.mix(low) & np.uint64(0xFF)).astype(np.uint8)
        a, b = _fingerprints(h, at) if len(some) else (np.zeros(0, np.int64),) * 2
        place = np.full(batch.num_rows, -1)
        place[some] = np.arange(len(some))
        place = pa.array(place, mask=place < 0)
        rooted = pa.FixedSizeListArray.from_arrays(pa.array(_roots(low).ravel()), TREES).cast(pa.list_(pa.int64()))
        signed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SLOTS), len(some), [None, pa.py_buffer(signature.tobytes())]).cast(pa.binary())
        columns = [batch.column(key), pa.array(size, pa.int64()), *(pa.array(x, pa.int64()).take(place) for x in (a, b)), rooted.take(place), signed.take(place)]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "a", "b", "keys", "sig"])


def _sets(batches: Iterator[pa.RecordBatch], key: str, text: str, n: int, bits) -> Iterator[pa.RecordBatch]:
    """Full sets of the documents whose id passes the filter."""
    for batch in batches:
        bit = batch.column("__bit").to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array((bits.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
        for part in ts.slices(iter([batch]), text):
            h, first = shingle_sets(part.column(text), n)
            some = np.flatnonzero(np.diff(first))
            if len(some):
                a, b = _fingerprints(h, first[:-1][some])
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(some)), pa.array(a), pa.array(b), pa.array([h[first[i] : first[i + 1]].tobytes() for i in some.tolist()], pa.binary())], names=["key", "a", "b", "items"])


def _whole_nodes(batches: Iterator[pa.RecordBatch], least: int, by: str = "node") -> Iterator[pa.Table]:
    """Tables of at least `least` rows, the last one aside, that never part a node; rows come sorted by node."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        kept = now if kept is None else pa.concat_tables([kept, now])
        if kept.num_rows >= least:
            node = kept[by].to_numpy()
            other = np.flatnonzero(node != node[-1])
            if len(other):
                yield kept.slice(0, int(other[-1]) + 1).combine_chunks()
                kept = kept.slice(int(other[-1]) + 1).combine_chunks()
    if kept is not None:
        yield kept.combine_chunks()
    ts.release()


def _alike(table: pa.Table, least: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows i, j of one node and different components whose signatures agree in `least` slots, and in how many."""
    node, comp, n = (table[c].to_numpy() for c in ("node", "comp", "n"))
    sig = ts.flat(table["sig"])[0].reshape(-1, SLOTS)
    out = [(np.zeros(0, np.int64),) * 3]
    for d in range(1, len(node)):
        at = np.flatnonzero(node[d:] == node[:-d])
        if not len(at):
            break
        at = at[(comp[at] != comp[at + d]) & (100 * np.minimum(n[at], n[at + d]) >= percent * np.maximum(n[at], n[at + d]))]
        for i in range(0, len(at), 16384):
            some = at[i : i + 16384]
            same = (sig[some] == sig[some + d]).sum(1)
            ok = same >= least
            out.append((some[ok], some[ok] + d, same[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _likely(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The members that are like one of another component in their node."""
    for table in _whole_nodes(batches, 4096):
        i, j, _ = _alike(table, least, percent)
        some = pa.array(np.unique(np.concatenate([i, j])))
        yield from table.select(["node", "rep", "comp"]).take(some).combine_chunks().to_batches()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two ordered sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _confirm(batches: Iterator[pa.RecordBatch], least: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between components, confirmed on full sets, that connect what can be connected in each node."""
    for table in _whole_nodes(batches, 256):
        i, j, same = _alike(table, least, percent)
        order = np.argsort(-same, kind="stable")
        node, comp = (table[c].to_numpy() for c in ("node", "comp"))
        items = table["items"].combine_chunks()
        root: dict[tuple[int, int], tuple[int, int]] = {}

        def top(x: tuple[int, int], root=root) -> tuple[int, int]:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        p, q = [], []
        for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
            own, other = top((node[a], comp[a])), top((node[b], comp[b]))
            if own == other:
                continue
            x, y = (np.frombuffer(items[k].as_buffer(), np.uint64) for k in (a, b))
            both = _common(x, y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                root[max(own, other)] = min(own, other)
                p.append(comp[a])
                q.append(comp[b])
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["p", "q"])


def _medoids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk of sorted rows, the member most like the commonest value of every slot."""
    for table in _whole_nodes(batches, 256, "chunk"):
        chunk, node, rep = (table[c].to_numpy() for c in ("chunk", "node", "rep"))
        sig = ts.flat(table["sig"])[0].reshape(-1, SLOTS)
        begin = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1]))
        out = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(chunk)], strict=True):
            votes = np.bincount((sig[a:b] + np.arange(SLOTS) * 256).ravel(), minlength=256 * SLOTS).reshape(SLOTS, 256)
            alike = (sig[a:b] == votes.argmax(1)).sum(1)
            out.append((node[a], rep[a + int(alike.argmax())], int(alike.max())))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["node", "rep", "alike"])


class _Join:
    def __init__(self, docs: DataFrame, key: str, text: str, n: int, percent: int):
        self.docs, self.key, self.text, self.n, self.percent = docs, key, text, n, percent
        self.scratch = Scratch(docs.sparkSession, "minhash")
        self.least = int(np.floor(SLOTS * (percent / 100 - 4 * (percent / 100 * (1 - percent / 100) / SLOTS) ** 0.5)))

    def sketch(self) -> tuple[DataFrame, DataFrame]:
        """All rows, and one representative of each set with its signature and roots."""
        kind = dict(self.docs.dtypes)[self.key]
        sketched = self.docs.select(self.key, self.text).mapInArrow(partial(_sketch, key=self.key, text=self.text, n=self.n), f"key {kind}, n bigint, a bigint, b bigint, keys array<bigint>, sig binary")
        rows = self.scratch.cut(sketched.withColumn("row", F.monotonically_increasing_id()), "rows")
        least = F.min_by(F.struct("row", "keys", "sig"), "key").alias("one")
        reps = rows.where("n > 0 and key is not null").groupBy("a", "b", "n").agg(F.min("key").alias("key"), least)
        return rows, self.scratch.cut(reps.select("one.*", "key", "a", "b", "n").withColumnRenamed("row", "rep"), "reps")

    def members(self, reps: DataFrame) -> DataFrame:
        """(tree, node, rep, n, size, items) of the root nodes with several members."""
        member = reps.select("rep", "n", F.posexplode("keys").alias("tree", "node"))
        nodes = member.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("items")).where("size > 1")
        return self.scratch.cut(member.join(nodes, "node"), "members")

    def involved(self, members: DataFrame, reps: DataFrame) -> DataFrame:
        """The representatives that share a node, with their signatures."""
        return self.scratch.cut(reps.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", "key", "a", "b", "n", "sig"), "involved")

    def sets(self, needed: DataFrame) -> DataFrame:
        """(rep, items) of representatives: one pass over the texts, of which only those whose id is sought are made into sets."""
        needed = self.scratch.cut(needed.select("rep", "key", "a", "b"), "needed")
        size = max(1 << 16, min(MAX_FILTER_BITS, 1 << (16 * needed.count()).bit_length()))
        bit = F.pmod(F.xxhash64("key"), F.lit(size))
        maps = needed.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
        bits = np.zeros(size + 1, np.uint8)
        # The iterator runs a job for every partition; one has about 8 MB of bits at most.
        for row in maps.coalesce(max(1, size >> 26)).toLocalIterator():
            # Bucket 1 has bits 1 to 32768, and so on; bit 0 is in bucket 0.
            found = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
            begin = (row["at"] - 1) * len(found) + 1 if row["at"] > 0 else 0
            bits[begin : begin + len(found)] |= found[: len(bits) - begin]
        known = self.docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
        source = self.docs.select(F.col(self.key).alias("key"), F.col(self.text).alias("text")).withColumn("__bit", bit).where("key is not null")
        full = source.mapInArrow(partial(_sets, key="key", text="text", n=self.n, bits=known), f"key {dict(needed.dtypes)['key']}, a bigint, b bigint, items binary")
        # A document that occurs twice under one id has one set.
        once = full.groupBy("key", "a", "b").agg(F.first("items").alias("items"))
        return self.scratch.cut(once.join(needed, ["key", "a", "b"]).select("rep", "items"), "sets")

    def likely(self, placed: DataFrame, involved: DataFrame) -> DataFrame:
        """Of (node, rep, comp) those whose signature is like one of another component in their node."""
        signed = placed.join(involved.select("rep", "n", "sig"), "rep").repartition("node").sortWithinPartitions("node", "rep")
        return self.scratch.cut(signed.mapInArrow(partial(_likely, least=self.least, percent=self.percent), "node bigint, rep bigint, comp bigint"), "likely")

    def linked(self, likely: DataFrame, involved: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (p, q) between the components of the likely members of nodes, confirmed on full sets."""
        full = likely.join(involved.select("rep", "n", "sig"), "rep").join(sets, "rep").repartition("node").sortWithinPartitions("node", "rep")
        return self.scratch.cut(full.mapInArrow(partial(_confirm, least=self.least, percent=self.percent), "p bigint, q bigint"), "links")

    def _parts(self):
        """Into how many chunks a node goes, so that chunks have at most about `NODE` members and `ITEMS` shingles."""
        return F.when(F.col("size") > 2, F.greatest(F.ceil(F.col("size") / NODE), F.ceil(F.col("items") / ITEMS))).otherwise(1)

    def first(self, members: DataFrame, involved: DataFrame) -> DataFrame:
        """Likely members of the root nodes of the first trees, or of their chunks, each with its node's medoid."""
        dealt = members.where(F.col("tree") < FIRST).withColumn("parts", self._parts())
        chunk = F.xxhash64("node", F.pmod(F.xxhash64("rep", F.lit(9)), F.col("parts")))
        dealt = dealt.withColumn("chunk", F.when(F.col("parts") > 1, chunk).otherwise(F.col("node")))
        large = self.scratch.cut(dealt.where("parts > 1").select("node", "chunk", "rep"), "large")
        placed = dealt.select(F.col("chunk").alias("node"), "rep", F.col("rep").alias("comp"))
        if not large.isEmpty():
            signed = large.join(involved.select("rep", "sig"), "rep").repartition("chunk").sortWithinPartitions("chunk", "rep")
            found = signed.select("node", "chunk", "rep", "sig").mapInArrow(_medoids, "node bigint, rep bigint, alike bigint")
            medoid = self.scratch.cut(found.groupBy("node").agg(F.max_by("rep", F.struct("alike", "rep")).alias("rep")), "medoids")
            guests = large.select("node", "chunk").distinct().join(medoid, "node").select(F.col("chunk").alias("node"), "rep", F.col("rep").alias("comp"))
            placed = placed.unionByName(guests)
        return self.likely(placed, involved)

    def mixed(self, level: DataFrame) -> DataFrame:
        """(node, small) of the nodes whose members aren't one component."""
        each = level.groupBy("node", "comp").agg(F.count("*").cast("double").alias("size"), F.sum("n").alias("items"))
        # Twice the pairs of different components.
        pairs = (F.col("size") * F.col("size") - F.col("squares")).alias("pairs")
        nodes = each.groupBy("node").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("size")).alias("squares"), F.sum("items").alias("items"), F.count("*").alias("comps"))
        few = (F.col("pairs") <= NODE * (NODE - 1)) & (F.col("size") <= WIDE) & (F.col("items") <= ITEMS)
        return nodes.where("comps > 1").select("node", "size", "items", pairs).select("node", ((F.col("size") <= 2) | few).alias("small"))

    def second(self, members: DataFrame, roots: DataFrame, involved: DataFrame) -> DataFrame:
        """Likely members of the nodes of all trees, branched until they're small, that aren't one component yet."""
        cut = self.scratch.cut
        roots = roots.select(F.col("node").alias("of"), "root")
        level = cut(members.join(roots, members["rep"] == roots["of"], "left").select("node", "rep", "n", F.coalesce("root", "rep").alias("comp")), "labelled")
        leaves = None
        for depth in range(DEPTH):
            mixed = cut(level.join(self.mixed(level), "node"), "mixed")
            small = mixed.where("small").select("node", "rep", "comp")
            leaves = small if leaves is None else leaves.unionByName(small)
            large = mixed.where("not small").drop("small")
            if large.isEmpty():
                break
            if not depth:  # from here on rows have their signatures with them
                large = cut(large.join(involved.select("rep", "sig"), "rep"), "large")
            places = [F.pmod(F.xxhash64("node", F.lit(i)), F.lit(SLOTS)).cast("int") for i in range(STEP)]
            token = [F.substring("sig", p + 1, F.lit(1)) for p in places]
            level = large.select(F.xxhash64("node", *token).alias("node"), "rep", "n", "comp", "sig")
        else:
            leaves = leaves.unionByName(large.select("node", "rep", "comp"))
        return self.likely(leaves, involved)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id and kept of every row. percent: the least 100 * intersection / union of a link."""
    join = _Join(docs, key, text, shingle, percent)
    rows, reps = join.sketch()
    members = join.members(reps)
    involved = join.involved(members, reps)
    likely = join.first(members, involved)
    sets = join.sets(involved.join(likely.select("rep").distinct(), "rep", "left_semi"))
    links = join.linked(likely, involved, sets)
    roots = components(links, join.scratch, "p", "q")
    likely = join.second(members, roots, involved)
    more = join.sets(involved.join(likely.select("rep").distinct(), "rep", "left_semi").join(sets.select("rep"), "rep", "left_anti"))
    links = join.linked(likely, involved, sets.unionByName(more))
    for table in (sets, more):
        join.scratch.drop(table)
    last = components(links, join.scratch, "p", "q").select(F.col("node").alias("of"), F.col("root").alias("last"))
    rooted = reps.select("rep", "key", "a", "b", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("of", F.coalesce("root", "rep"))
    placed = join.scratch.cut(rooted.join(last, "of", "left").withColumn("root", F.coalesce("last", "of")).drop("of", "last"), "placed")
    least = placed.groupBy("root").agg(F.min("key").alias("component"))
    found = join.scratch.cut(placed.join(least, "root").select("a", "b", "n", "component"), "components")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return rows.select("key", "n", "a", "b").join(found, ["a", "b", "n"], "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
