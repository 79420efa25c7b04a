"""Embedding near-dedup by product quantisation.

A coarse quantiser deals unit vectors to inverted lists; what is left of a vector after its
list's centre is coded in subspaces. For a query the distances to all codes of a subspace are
tabled once, and the distance to a coded vector is a sum of look-ups (asymmetric distance).

A link of cosine c means a distance of at most r = sqrt(2 - 2c) between unit vectors. A query
looks into every list whose bordering plane to its own is near enough: a partner lies beyond the
plane only if the part of their difference that is normal to it reaches that far. Of a difference
in no special direction that part has the standard deviation r / sqrt(d); lists up to `REACH` of
these are probed, and never more than r, beyond which there is nothing (up to d = 16 all that can hold
a link). A pair is lost only if either side misses the other. In a list a query keeps every coded
vector whose look-up distance is at most r plus that vector's own coding error, which loses nothing.

Two passes keep the rows small. The first sends codes and errors of the entries to their list, and
the query's vector to the lists that it probes; what comes back are the members of each group that
have a candidate. Only for these the second sends vectors, and compares by exact cosine in double
precision.

Vectors that are equal are one representative with a multiplicity. There are about as many lists as
the root of the vectors a label has. The lists of a label are dealt into chunks of about `CHUNK`
vectors and so are the queries of a list, whatever the sizes; a task compares two chunks, counts links for
each vector and reports connections by one row a vector, never pair by pair.

Centres and codes are fitted on `SAMPLE` vectors, taken in the order of a hash of their ids;
every vector is coded. Broadcast are the centres and codes only: at most `MAX_LISTS` centres.

Vectors of different lengths link with nothing; each length is searched by itself, with a
quantiser of its own.

Defined cases: a null, zero or non-finite vector and a vector with a null label link with
nothing; every row is a vector of its own, repeated ones too; rows with a null id link with nothing
and have a null component; ties don't arise, since the least id names a component; an empty
table gives no rows. Only key, vector and label are read, so other names may clash with results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.components import components
from loreloom.llm.scratch import Scratch

SAMPLE = 20_000
SUBSPACES, CODES = 8, 64
MIN_LISTS, MAX_LISTS = 16, 4096
REACH = 4.0
CHUNK = 2048
_SLACK = 1e-4


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.stack([np.bincount(own, weights=x[:, j], minlength=len(centres)) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


class Quantiser:
    def __init__(self, sample: np.ndarray, lists: int, cosine: float):
        self.radius = float(np.sqrt(2 - 2 * cosine)) + _SLACK
        self.centres = kmeans(sample, min(lists, len(sample)))
        residual = sample - self.centres[_nearest(sample, self.centres)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.codes = [kmeans(residual[:, p], min(CODES, len(sample)), seed=11 + i) for i, p in enumerate(self.parts)]
        gap = self.centres[:, None] - self.centres[None]
        self.apart = np.sqrt((gap**2).sum(2))

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of unit vectors."""
        own = _nearest(unit, self.centres)
        residual = unit - self.centres[own]
        codes = np.stack([_nearest(residual[:, p], c) for p, c in zip(self.parts, self.codes, strict=True)], 1)
        error = sum(((residual[:, p] - c[codes[:, i]]) ** 2).sum(1) for i, (p, c) in enumerate(zip(self.parts, self.codes, strict=True)))
        return own, codes.astype(np.uint8), np.sqrt(error)

    def probes(self, unit: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For each vector, which lists may hold a vector within the radius."""
        d2 = (self.centres**2).sum(1) - 2 * unit @ self.centres.T
        lead = d2 - d2[np.arange(len(unit)), own][:, None]
        plane = lead / np.maximum(2 * self.apart[own], 1e-30)
        return (plane <= self.radius * min(1.0, REACH / self.centres.shape[1] ** 0.5)) | (np.arange(len(self.centres)) == own[:, None])

    def near(self, queries: np.ndarray, at: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Whether each coded vector of list `at` may lie within the radius of each query."""
        residual = queries - self.centres[at]
        total = np.zeros((len(queries), len(codes)))
        for i, (p, c) in enumerate(zip(self.parts, self.codes, strict=True)):
            q = residual[:, p]
            tabled = (q**2).sum(1)[:, None] - 2 * q @ c.T + (c**2).sum(1)
            total += tabled[:, codes[:, i]]
        return total <= (self.radius + error) ** 2


def _units(column, width: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(batches: Iterator[pa.RecordBatch], quantiser, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = _units(batch.column("v"), width)
        own, codes, error = quantiser.value.encode(unit)
        probes = [np.flatnonzero(r).tolist() for r in quantiser.value.probes(unit, own)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))],
            names=[*batch.schema.names, "list", "codes", "error", "probes"],
        )


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n reaches over links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


_BLOCK = 256
_GROUP = ["label", "at", "chunk", "part"]


def _pairs(own: np.ndarray, rep: np.ndarray, q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which queries compare with which entries: a pair meets once, from the smaller list, and within a list from the smaller id."""
    return (own[q][:, None] < own[e][None]) | ((own[q][:, None] == own[e][None]) & (rep[q][:, None] < rep[e][None]))


def _candidates(table: pa.Table, quantiser, width: int) -> pa.Table:
    """One group: queries of a chunk against the codes of a chunk of one list. The members that have a candidate."""
    is_query, own, rep, error = (table[c].to_numpy() for c in ("query", "list", "rep", "error"))
    q, e = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    hit = np.zeros(table.num_rows, bool)
    if len(q) and len(e):
        unit = _units(table["v"].take(pa.array(q)), width)
        codes = np.frombuffer(b"".join(table["codes"].take(pa.array(e)).to_pylist()), np.uint8).reshape(len(e), -1)
        for i in range(0, len(q), _BLOCK):
            some = q[i : i + _BLOCK]
            may = quantiser.value.near(unit[i : i + _BLOCK], table["at"][0].as_py(), codes, error[e]) & _pairs(own, rep, some, e)
            hit[some] |= may.any(1)
            hit[e] |= may.any(0)
    return table.select([*_GROUP, "rep", "query", "list", "times"]).filter(pa.array(hit))


def _compare(table: pa.Table, cosine: float, width: int) -> pa.Table:
    """One group: exact cosines. A row a vector with links: their number and one to connect by."""
    is_query, own, rep, times = (table[c].to_numpy() for c in ("query", "list", "rep", "times"))
    q, e = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    norm = np.linalg.norm(x, axis=1)
    unit = x / norm[:, None]
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in range(0, len(q), _BLOCK):
        some = q[k : k + _BLOCK]
        a, b = np.nonzero((unit[some] @ unit[e].T >= cosine - 1e-9) & _pairs(own, rep, some, e))
        a, b = some[a], e[b]
        exact = np.concatenate([np.zeros(0, bool), *(np.einsum("ij,ij->i", x[a[s : s + 65536]], x[b[s : s + 65536]]) / (norm[a[s : s + 65536]] * norm[b[s : s + 65536]]) >= cosine for s in range(0, len(a), 65536))])
        i.append(a[exact])
        j.append(b[exact])
    i, j = np.concatenate(i), np.concatenate(j)
    n = np.bincount(i, weights=times[j], minlength=len(rep)) + np.bincount(j, weights=times[i], minlength=len(rep))
    root = _roots(len(rep), i, j)
    some = np.flatnonzero(n)
    return pa.table({"rep": rep[some], "links": n[some].astype(np.int64), "to": rep[root[some]]})


def _known(usable: DataFrame, scratch: Scratch, width: int, cosine: float, lists: int | None, sample: int) -> DataFrame:
    """label, v, n_links and component of the distinct vectors of one length."""
    spark = usable.sparkSession
    reps = scratch.cut(usable.groupBy("label", "v").agg(F.min("node").alias("rep"), F.min("key").alias("low"), F.count("*").alias("times")), "reps")
    learn = np.array([r[0] for r in reps.orderBy(F.xxhash64("low", F.lit(3))).limit(sample).select("v").collect()], np.float64)
    if lists is None:
        n, labels = reps.agg(F.count("*"), F.approx_count_distinct("label")).first()
        lists = int(np.clip((n / max(1, labels)) ** 0.5, MIN_LISTS, MAX_LISTS))
    quantiser = spark.sparkContext.broadcast(Quantiser(learn / np.linalg.norm(learn, axis=1, keepdims=True), lists, cosine))
    types = dict(reps.dtypes)
    coded = reps.select("rep", "label", "times", "v").mapInArrow(partial(_code, quantiser=quantiser, width=width), f"rep bigint, label {types['label']}, times bigint, v {types['v']}, list int, codes binary, error double, probes array<int>")
    coded = scratch.cut(coded, "coded")
    chunks = scratch.cut(coded.groupBy("label", "list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks")
    own = scratch.cut(coded.join(chunks, ["label", "list"]).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("chunks")).cast("int")).drop("chunks"), "dealt")
    # Queries meet the chunks of every list at or above their own that they probe; a group is a chunk of a list and a part of its queries.
    probing = scratch.cut(own.select("rep", "label", "list", F.explode(F.filter("probes", lambda p: p >= F.col("list"))).alias("at")), "probing")
    target = scratch.cut(probing.groupBy("label", "at").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts")).join(chunks.withColumnRenamed("list", "at"), ["label", "at"]), "target")
    nothing = lambda kind: F.lit(None).cast(kind)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    queries = probing.join(target, ["label", "at"]).withColumn("part", F.pmod(F.xxhash64("rep", F.lit(2)), "parts").cast("int")).withColumn("chunk", every("chunks")).select("rep", "at", "chunk", "part").join(own.select("rep", "label", "times", "list", "v"), "rep")
    queries = queries.select("label", "at", "chunk", "part", "rep", "times", "list", "v", nothing("binary").alias("codes"), F.lit(0.0).alias("error"), F.lit(True).alias("query"))
    entries = own.withColumnRenamed("list", "at").join(target, ["label", "at"]).withColumn("part", every("parts"))
    entries = entries.select("label", "at", "chunk", "part", "rep", "times", F.col("at").alias("list"), nothing(types["v"]).alias("v"), "codes", "error", F.lit(False).alias("query"))
    kinds = dict(queries.dtypes)
    likely = queries.unionByName(entries).groupBy(*_GROUP).applyInArrow(lambda t: _candidates(t, quantiser, width), ", ".join(f"{c} {kinds[c]}" for c in [*_GROUP, "rep", "query", "list", "times"]))
    likely = scratch.cut(likely, "likely")
    full = likely.join(reps.select("rep", "v"), "rep")
    found = scratch.cut(full.groupBy(*_GROUP).applyInArrow(lambda t: _compare(t, cosine, width), "rep bigint, links bigint, to bigint"), "found")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found, scratch, "rep", "to").select(F.col("node").alias("rep"), "root")
    placed = scratch.cut(reps.select("rep", "label", "v", "low", "times").join(roots, "rep", "left").join(counted, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "placed")
    least = scratch.cut(placed.groupBy("root").agg(F.min("low").alias("component")), "least")
    return scratch.cut(placed.join(least, "root").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component"), "known")


def near_duplicate_vectors(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, lists: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """key, n_links, component_id and kept, one row for each row. lists: their number, else as many as the vectors call for."""
    scratch = Scratch(vectors.sparkSession, "pq")
    kind = dict(vectors.dtypes)[vector]
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull() & F.col("key").isNotNull()
    rows = scratch.cut(rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("node", F.monotonically_increasing_id()), "rows")
    usable = rows.where("sound")
    widths = sorted(r["n"] for r in usable.select(F.size("v").alias("n")).distinct().collect())
    alone = rows.select("key", "node")
    if not widths:
        return alone.select(F.col("key").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    known = reduce(DataFrame.unionByName, [_known(usable.where(F.size("v") == n), scratch, n, cosine, lists, sample) for n in widths])
    joined = usable.select("node", "label", "v").join(known, ["label", "v"]).select("node", "n_links", "component")
    out = alone.join(joined, "node", "left").withColumn("component", F.when(F.col("key").isNotNull(), F.coalesce("component", "key")))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("key") == F.col("component"), F.lit(True)).alias("kept"))
