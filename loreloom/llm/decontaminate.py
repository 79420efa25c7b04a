"""Benchmark decontamination.

The windows of all benchmark items (`window` consecutive normalised words; an item of
fewer words is one window) become a set of 64-bit hashes that is broadcast. One pass
over the documents hashes every token window, looks it up, verifies each hit word by
word and marks the words it covers. There is no shuffle of text.

Bound of the broadcast: the driver reads the benchmark in sets of about `max_windows`
windows. One set goes out as it is. A larger benchmark gets a pass over the documents for
each set, and the passes' word spans are united per document row, so that the result is
the same whatever the size.

Defined cases: a null or empty text has no words and is clean; an item without words
never hits; one with a null id hits without being named; repeated items and repeated
document rows each keep their own row; columns other than the named ones are neither read
nor needed, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm import textscan as ts
from loreloom.llm.scratch import Scratch

WINDOW = 10
#: Of a pass; a worker holds about a kilobyte for each.
MAX_WINDOWS = 200_000


@dataclass
class WindowSet:
    """Benchmark windows by length: sorted hashes, the window's words, the items that have it."""

    by_length: dict[int, tuple[np.ndarray, list[tuple[bytes, ...]], list[tuple[str, ...]]]] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple[str | None, str]], n: int) -> WindowSet:
        found: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        hashes: dict[tuple[bytes, ...], int] = {}
        for item, text in rows:
            w = ts.words(pa.array([text], pa.string()), ts.ALNUM)
            length = min(n, len(w.hash))
            if not length:
                continue
            for h, at in zip(*ts.windows(w, length), strict=True):
                key = tuple(w.word(i) for i in range(at, at + length))
                found.setdefault(length, {}).setdefault(key, set()).update(() if item is None else (item,))
                hashes[key] = int(h)
        out = cls()
        for length, by_key in found.items():
            keys = sorted(by_key, key=lambda k: hashes[k])
            out.by_length[length] = (np.array([hashes[k] for k in keys], np.uint64), keys, [tuple(sorted(by_key[k])) for k in keys])
        return out

    def __len__(self) -> int:
        return sum(len(h) for h, _, _ in self.by_length.values())

    def match(self, w: ts.Words) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(index of first word, number of words, items) of every occurrence in a slice."""
        for length, (known, keys, items) in self.by_length.items():
            h, at = ts.windows(w, length)
            gate = np.zeros(1 << 20, bool)
            gate[known >> np.uint64(44)] = True
            some = np.flatnonzero(gate[h >> np.uint64(44)])
            lo, hi = np.searchsorted(known, h[some], "left"), np.searchsorted(known, h[some], "right")
            for pos, a, b in zip(at[some].tolist(), lo.tolist(), hi.tolist(), strict=True):
                if a < b:
                    mine = tuple(w.word(i) for i in range(pos, pos + length))
                    for k in range(a, b):
                        if keys[k] == mine:
                            yield pos, length, items[k]


def window_sets(benchmark: DataFrame, item: str, text: str, window: int, limit: int) -> Iterator[WindowSet]:
    """Sets of at least `limit` windows, but for the last; the driver holds one or two of them and one row at a time."""
    rows, size = [], 0
    for name, words in benchmark.select(F.col(item).cast("string"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        rows.append((name, words))
        size += 1 + len(words) // 2
        if size >= limit:
            yield WindowSet.build(rows, window)
            rows, size = [], 0
    yield WindowSet.build(rows, window)


_SPAN = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
_HITS = f"n_words bigint, n_hit bigint, items array<string>, spans {_SPAN}"


def _scan(known, text: str):
    """One row per document: words, and the hit runs of words as (first, last + 1, first byte, last byte + 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, text):
            w = ts.words(batch.column(text), ts.ALNUM)
            covered = np.zeros(len(w.hash) + 1, np.int64)
            items: dict[int, set[str]] = {}
            for pos, length, names in known.value.match(w):
                covered[pos] += 1
                covered[pos + length] -= 1
                items.setdefault(int(np.searchsorted(w.first, pos, "right")) - 1, set()).update(names)
            hit = np.cumsum(covered[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[w.first[1:]] - total[w.first[:-1]]
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row in np.flatnonzero(n_hit).tolist():
                a, b = int(w.first[row]), int(w.first[row + 1])
                edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    spans[row].append({"first": s, "last": e, "start": int(w.start[a + s] - w.off[row]), "end": int(w.end[a + e - 1] - w.off[row])})
            kept = [c for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in kept),
                    pa.array(np.diff(w.first), pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([sorted(items.get(r, ())) for r in range(batch.num_rows)], pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")]))),
                ],
                names=[*kept, "n_words", "n_hit", "items", "spans"],
            )

    return run


def _by_row(numbered: DataFrame, sets: Iterator[WindowSet], scratch: Scratch, text: str) -> DataFrame:
    """Hits by __row for a benchmark of several sets: a pass for each, written before the next set is made, then the union of their spans."""
    context, passes = numbered.sparkSession.sparkContext, None
    for windows in sets:
        known = context.broadcast(windows)
        one = scratch.cut(numbered.select("__row", text).mapInArrow(_scan(known, text), f"__row bigint, {_HITS}"), "pass")
        known.destroy()
        passes = one if passes is None else passes.unionByName(one)
    united = passes.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"))

    def join_runs(acc, x):
        top = F.element_at(acc, -1)
        grown = F.struct(top["first"].alias("first"), F.greatest(top["last"], x["last"]).alias("last"), top["start"].alias("start"), F.greatest(top["end"], x["end"]).alias("end"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= x["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(x)))

    out = united.withColumn("spans", F.aggregate("s", F.array().cast(_SPAN), join_runs))
    return out.select("__row", "n_words", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"]).alias("n_hit"), "items", "spans")


def _numbered(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(docs.sparkSession, "decontaminate")
    return scratch.cut(docs.select(*columns, F.monotonically_increasing_id().alias("__row")), "rows"), scratch


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """key, n_words, n_hit, items (sorted strings) and spans (word and byte positions), one row per document row."""
    sets = window_sets(benchmark, item, item_text, window, max_windows)
    first = next(sets)
    second = next(sets, None)
    if second is None:
        known = docs.sparkSession.sparkContext.broadcast(first)
        return docs.select(key, text).mapInArrow(_scan(known, text), f"`{key}` {dict(docs.dtypes)[key]}, {_HITS}")
    numbered, scratch = _numbered(docs, [key, text])
    return numbered.select(key, "__row").join(_by_row(numbered, chain((first, second), sets), scratch, text), "__row").drop("__row")


def _cut_spans(batches: Iterator[pa.RecordBatch], text: str, spans: str, action: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = batch.column(spans).to_pylist()
        batch = batch.select([c for c in batch.schema.names if c != spans])
        if action == "documents":
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))
            continue
        at = batch.schema.get_field_index(text)
        out = batch.column(text).to_pylist()
        for row, runs in enumerate(found):
            if runs:
                raw, left, pieces = out[row].encode(), 0, []
                for run in runs:
                    pieces.append(raw[left : run["start"]])
                    left = run["end"]
                out[row] = b"".join([*pieces, raw[left:]]).decode()
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, action: str = "documents", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without contamination, with the same columns.

    action `documents` drops every document that has a hit; `spans` keeps all documents and
    takes the hit runs of words out of their texts. Rows are judged one by one, so that rows
    with a null or repeated key are handled like any other.
    """
    if action not in ("documents", "spans"):
        raise ValueError(f"action is {action!r}")
    sets = window_sets(benchmark, item, item_text, window, max_windows)
    first = next(sets)
    second = next(sets, None)
    if second is not None:
        numbered, scratch = _numbered(docs, docs.columns)
        hits = _by_row(numbered, chain((first, second), sets), scratch, text).select("__row", F.col("spans").alias("__spans"))
        joined = numbered.join(hits, "__row", "left").drop("__row")
        return joined.mapInArrow(lambda b: _cut_spans(b, text, "__spans", action), docs.schema)
    known = docs.sparkSession.sparkContext.broadcast(first)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in ts.slices(batches, text):
            found = next(_scan(known, text)(iter([batch.select([text])]))).column("spans")
            yield from _cut_spans(iter([pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "__spans"])]), text, "__spans", action)

    return docs.mapInArrow(clean, docs.schema)
