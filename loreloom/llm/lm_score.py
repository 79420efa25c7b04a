"""Language-model scoring with a log-frequency Bloom filter.

Counts of tokens and of pairs of tokens over the training documents are quantised on a
logarithmic scale; a count of level q puts the n-gram with the labels 1 to q into a Bloom
filter. The level of an n-gram is read back by probing label after label until one is
missing, and gives an estimate of its count. The probability of a token is its pair estimate
smoothed by the token's own (Dirichlet prior of weight `MU`).

The filter is blocked: the hash of the n-gram names one block, all its probes fall there, so
a reducer that owns a block writes it out whole. Its size follows the number of n-grams at
`BITS` bits for each label. `MAX_BYTES` bounds the broadcast: a larger filter goes out in
shards of whole blocks with a pass over the text for each. An n-gram's block lies in one shard,
so the passes carry every token's two levels along, and the scores don't depend on `MAX_BYTES`.
A shard goes out in pieces of `PIECE` bytes as its blocks arrive; the driver's Python holds one piece.

The base score needs exact counts. The most frequent tokens, `EXACT` at most and all above one
count, go out as a sorted table; the rest of a document's tokens is joined with the counts by hash.
The count comes from a histogram, as a top-k would send that many tokens of every partition to one place.

Defined cases: a null text is empty and still has its end token; a null id has checksum key
null, counts as training text and keeps a row; repeated rows are scored each and train each.
An empty table gives no rows. Where there is no training text, N and all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm import textscan as ts
from loreloom.llm.scratch import Scratch

BITS = 12
MAX_BYTES = 64 << 20
PIECE = 4 << 20
EXACT = 1 << 18
MU = 50.0
PROBES = 3
BASE = 2.0
_BLOCK = 1 << 13  # bytes
END = ts.mix(np.array([0x454E44], np.uint64))[0]
_PAIR = np.uint64(0xA24BAED4963EE407)


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of every row, its end token last, and where each row begins."""
    w = ts.words(column, ts.NON_SPACE)
    n = np.diff(w.first)
    first = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.empty(first[-1], np.uint64)
    out[first[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    out[inner] = w.hash
    return out, first


def _pairs(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The pair that ends with each token; a row's first token pairs with the end before it."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = END
    return ts.mix(before * _PAIR + tokens)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in ts.slices(batches, "text", 8 << 20):
        tokens, first = _tokens(batch.column("text"))
        for kind, grams in ((1, tokens), (2, _pairs(tokens, first))):
            h, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int8)), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["kind", "h", "n"])


def _level(n: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and one more with each doubling (rounded)."""
    return 1 + np.rint(np.log(np.maximum(n, 1)) / np.log(BASE)).astype(np.int64)


def _estimate(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, BASE ** (level - 1.0), 0.0)


def _bits(h: np.ndarray, label: int) -> list[np.ndarray]:
    x = ts.mix(h + np.uint64(label) * np.uint64(0x9E3779B97F4A7C15))
    return [((x >> np.uint64(16 * i)) & np.uint64(8 * _BLOCK - 1)).astype(np.int64) for i in range(PROBES)]


def _fill(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(8 * _BLOCK, bool)
    for batch in batches:
        h = batch.column("h").to_numpy().view(np.uint64)
        level = _level(batch.column("n").to_numpy())
        for label in range(1, int(level.max(initial=0)) + 1):
            for at in _bits(h[level >= label], label):
                bits[at] = True
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])


def _probe(filled: np.ndarray, h: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Levels of n-grams in blocks of the filter: labels are probed in turn until one is missing."""
    level = np.zeros(len(h), np.int8)
    begin = block * (8 * _BLOCK)
    alive = np.arange(len(h))
    label = 0
    while len(alive) and label < 64:
        label += 1
        there = np.ones(len(alive), bool)
        for at in _bits(h[alive], label):
            at = at + begin[alive]
            there &= (filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        alive = alive[there]
        level[alive] = label
    return level


class _Piece:
    """Blocks on their way to the executors: it pickles as their array, and is emptied once that is done."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __reduce__(self):
        return np.frombuffer, (self.bits, np.uint8)


class _Shard:
    """Blocks `begin` to `end` of the filter, broadcast in pieces in the order in which they arrive."""

    def __init__(self, blocks: DataFrame, begin: int, end: int, n_blocks: int):
        self.begin, self.n_blocks = begin, n_blocks
        self.slot = np.full(end - begin, -1, np.int32)  # a block without n-grams doesn't arrive
        self.width = max(1, PIECE // _BLOCK)
        self.pieces = []
        held, n = [], 0
        for row in blocks.where((F.col("block") >= begin) & (F.col("block") < end)).toLocalIterator():
            self.slot[row["block"] - begin] = n
            held.append(row["bits"])
            n += 1
            if len(held) == self.width:
                self._send(blocks, held)
        if held:
            self._send(blocks, held)

    def _send(self, blocks: DataFrame, held: list[bytearray]) -> None:
        piece = _Piece(b"".join(held))
        held.clear()
        self.pieces.append(blocks.sparkSession.sparkContext.broadcast(piece))
        piece.bits = b""

    def destroy(self) -> None:
        for piece in self.pieces:
            piece.destroy()

    def levels(self, h: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Levels of n-grams in blocks counted from the shard's first."""
        at = self.slot[block].astype(np.int64)
        piece = at // self.width
        order = np.argsort(piece.astype(np.int16) if len(self.pieces) < 1 << 15 else piece, kind="stable")
        bounds = np.searchsorted(piece[order], np.arange(len(self.pieces) + 1))
        level = np.zeros(len(h), np.int8)
        for i, part in enumerate(self.pieces):
            own = order[bounds[i] : bounds[i + 1]]
            if len(own):
                level[own] = _probe(part.value, h[own], at[own] - i * self.width)
        return level


def _levels(batch: pa.RecordBatch, name: str, grams: np.ndarray, shard: _Shard) -> np.ndarray:
    """The n-grams' levels as carried in column `name`, with those of a shard's blocks looked up."""
    level = np.frombuffer(b"".join(batch.column(name).to_pylist()), np.int8).copy() if name in batch.schema.names else np.zeros(len(grams), np.int8)
    inside = slice(None)
    if len(shard.slot) < shard.n_blocks:
        block = (grams % np.uint64(shard.n_blocks)).astype(np.int64) - shard.begin
        inside = np.flatnonzero((block >= 0) & (block < len(shard.slot)))
    u, back = np.unique(grams[inside], return_inverse=True)
    level[inside] = shard.levels(u, (u % np.uint64(shard.n_blocks)).astype(np.int64) - shard.begin)[back]
    return level


def _carried(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """The rows with the levels of their tokens and pairs, as far as the shards seen go; one byte each."""
    for batch in ts.slices(batches, "text", 8 << 20):
        tokens, first = _tokens(batch.column("text"))
        levels = [_levels(batch, name, grams, model) for name, grams in (("own", tokens), ("both", _pairs(tokens, first)))]
        offsets = pa.py_buffer(first.astype(np.int32))
        carried = [pa.BinaryArray.from_buffers(pa.binary(), batch.num_rows, [None, offsets, pa.py_buffer(x)]) for x in levels]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "text", "held_out")), *carried], names=["key", "text", "held_out", "own", "both"])


def _scored(batches: Iterator[pa.RecordBatch], model, exact) -> Iterator[pa.RecordBatch]:
    """Scores, and the tokens outside the exact table as (token, times in the row)."""
    known, count, total, distinct = exact.value
    for batch in ts.slices(batches, "text", 8 << 20):
        tokens, first = _tokens(batch.column("text"))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(first))
        u, back = np.unique(tokens, return_inverse=True)
        at = np.minimum(np.searchsorted(known, u), max(0, len(known) - 1))
        found = known[at] == u if len(known) else np.zeros(len(u), bool)
        p_base = np.where(found, np.log10((count[at] + 0.5) / (total + 0.5 * (distinct + 1))), 0.0) if len(known) else np.zeros(len(u))
        some = np.flatnonzero(~found[back])
        rare, times = np.unique(owner[some] * len(u) + back[some], return_counts=True)
        begin = np.searchsorted(rare // len(u), np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.StructArray.from_arrays([pa.array(u[rare % len(u)].view(np.int64)), pa.array(times, pa.int64())], names=["h", "times"]))
        own = _estimate(_levels(batch, "own", tokens, model))
        both = _estimate(_levels(batch, "both", _pairs(tokens, first), model))
        # A row's last token is the end, which also comes before its first.
        context = np.empty_like(own)
        context[1:] = own[:-1]
        context[first[:-1]] = own[first[1:] - 1]
        lower = np.minimum(1.0, (own + 0.5) / (total + 0.5 * (distinct + 1)))
        p = (np.minimum(both, context) + MU * lower) / (context + MU)
        add = lambda x: np.bincount(owner, weights=x, minlength=batch.num_rows)
        columns = [pa.array(np.diff(first), pa.int64()), pa.array(add(found[back]).astype(np.int64)), pa.array(add(p_base[back])), pa.array(add(np.log10(p))), lists]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("held_out"), *columns], names=["key", "held_out", "n_tokens", "n_known", "base", "score", "rare"])


def _frequent(single: DataFrame, most: int) -> pa.Table:
    """The tokens above one count, as low as leaves `most` of them at most."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 32)
    least, n = None, 0
    for row in sorted(single.groupBy(step.alias("step")).count().collect(), reverse=True):
        n += row["count"]
        if n > most:
            break
        least = row["step"]
    return single.where(step >= least if least is not None else F.lit(False)).toArrow()


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1, exact_tokens: int = EXACT) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Documents whose crc32(key as text) mod folds is `held` are held out; the others train.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    out_of = F.coalesce(F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(folds)) == held, F.lit(False))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), out_of.alias("held_out"))
    partial_counts = source.where("not held_out").select("text").mapInArrow(_counts, "kind tinyint, h bigint, n bigint")
    counts = scratch.cut(partial_counts.groupBy("kind", "h").agg(F.sum("n").alias("n")), "counts")
    single = counts.where("kind = 1").select("h", "n")
    total, distinct = (x or 0 for x in single.agg(F.sum("n"), F.count("*")).first())
    labels = counts.select(F.sum(1 + F.rint(F.log(F.col("n").cast("double")) / F.log(F.lit(BASE))))).first()[0] or 0
    n_blocks = int(max(1, labels * BITS / 8 // _BLOCK))
    shard_blocks = max(1, MAX_BYTES // _BLOCK)
    # h is a 64-bit pattern: its unsigned remainder names the block.
    signed = F.pmod(F.pmod("h", F.lit(n_blocks)) + F.when(F.col("h") < 0, F.lit((1 << 64) % n_blocks)).otherwise(F.lit(0)), F.lit(n_blocks))
    blocks = counts.select(signed.alias("block"), "h", "n").groupBy("block").applyInArrow(_fill, "block bigint, bits binary")
    blocks = scratch.cut(blocks, "blocks")
    shard = lambda begin: _Shard(blocks, begin, min(n_blocks, begin + shard_blocks), n_blocks)
    *others, last = range(0, n_blocks, shard_blocks)
    rows = source
    for begin in others:
        model, before = shard(begin), rows
        rows = scratch.cut(before.mapInArrow(partial(_carried, model=model), f"{', '.join(f'{n} {t}' for n, t in source.dtypes)}, own binary, both binary"), "levels")
        scratch.drop(before)
        model.destroy()
    model = shard(last)
    top = _frequent(single, exact_tokens)
    known = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(known)
    exact = spark.sparkContext.broadcast((known[order], top.column("n").to_numpy()[order].astype(np.float64), float(total), float(distinct)))
    schema = f"key {dict(source.dtypes)['key']}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<h:bigint,times:bigint>>"
    main = scratch.cut(rows.mapInArrow(partial(_scored, model=model, exact=exact), schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    for used in (model, exact):
        used.destroy()
    for used in (rows, blocks):
        scratch.drop(used)
    rare = main.select("row", F.explode("rare").alias("x")).select("row", "x.h", "x.times")
    weight = lambda c: F.log10((c + 0.5) / F.lit(total + 0.5 * (distinct + 1)))
    joined = rare.join(single, "h", "left").groupBy("row").agg(F.sum(F.col("times") * weight(F.coalesce("n", F.lit(0)))).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    return main.drop("rare").join(joined, "row", "left").select(F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
