"""Token ids packed into rows of a fixed length, best fit decreasing.

Each task packs pools of about `POOL` ids. Documents longer than a row are cut into pieces of
a row and a rest, which are placed like others, so that no id is lost. Pieces go, longest
first, into the open row with the least room that suffices; a segment tree over the rooms
finds it. A packed row has its ids, the cumulative lengths of its segments, positions that
begin anew in each segment, and for each segment the document and its offset there.

Ids and positions are little-endian 16-bit matrices' rows, `length` wide, with `pad` behind
the last segment. What a row depends on is its task's input alone, so lost tasks repeat.

Defined cases: a document without ids has no segment; repeated rows are documents of their
own; a null id stays null in `doc_ids`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm import textscan as ts
from loreloom.llm.tokenize import PieceEncoder

LENGTH = 2048
POOL = 4 << 20


class Rooms:
    """Open rows by the room they have left; finds the least room that is large enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]
        self.count = [0] * (2 * self.size)

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of the best fit, removed."""
        i = least + self.size
        while not self.count[i]:
            while i & 1:  # a right child: nothing above it is larger
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers; every size is from 1 to length."""
    rooms, rows = Rooms(length), []
    for piece in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[piece])
        found = rooms.take(size)
        room, row = found if found else (length, len(rows))
        if not found:
            rows.append([])
        rows[row].append(piece)
        if room > size:
            rooms.put(room - size, row)
    return rows


def _pack(batches: Iterator[pa.RecordBatch], path: str, pattern: str, length: int, pad: int, pool: int) -> Iterator[pa.RecordBatch]:
    encoder = PieceEncoder(path, pattern)
    names = ["n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "input_ids", "position_ids"]

    def pack(ids: np.ndarray, bounds: np.ndarray, keys: list, kind: pa.DataType) -> pa.RecordBatch:
        n = np.diff(bounds)
        pieces = -(-n // length)
        doc = np.repeat(np.arange(len(n)), pieces)
        offset = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
        size = np.minimum(length, n[doc] - offset)
        out: dict[str, list] = {x: [] for x in names}
        for row in best_fit_decreasing(size, length):
            matrix, position = np.full(length, pad, "<u2"), np.zeros(length, "<u2")
            at = 0
            for p in row:
                begin, m = bounds[doc[p]] + offset[p], size[p]
                matrix[at : at + m] = ids[begin : begin + m]
                position[at : at + m] = np.arange(m)
                at += m
            values = (at, [keys[doc[p]] for p in row], offset[row].tolist(), [0, *np.cumsum(size[row]).tolist()], matrix.tobytes(), position.tobytes())
            for name, value in zip(names, values, strict=True):
                out[name].append(value)
        kinds = (pa.int64(), pa.list_(kind), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(out[x], k) for x, k in zip(names, kinds, strict=True)], names=names)

    waiting: list[tuple[np.ndarray, np.ndarray, list]] = []
    kind = None

    def flush() -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(i) for i, _, _ in waiting)])
        bounds = np.concatenate([[0], *(b[1:] + e for (_, b, _), e in zip(waiting, ends, strict=False))])
        out = pack(np.concatenate([i for i, _, _ in waiting]), bounds, [k for _, _, ks in waiting for k in ks], kind)
        waiting.clear()
        return out

    for batch in ts.slices(batches, "text"):
        kind = batch.column("key").type
        waiting.append((*encoder.encode(batch.column("text")), batch.column("key").to_pylist()))
        if sum(len(i) for i, _, _ in waiting) >= pool:
            yield flush()
    if waiting:
        yield flush()


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, *, pad: int, key: str = "doc_id", text: str = "text", length: int = LENGTH, pool: int = POOL) -> DataFrame:
    """pack (its number), n_tokens, doc_ids, doc_offsets, cu_seqlens, input_ids and position_ids of every packed row."""
    if not 0 < length <= 1 << 16 or not 0 <= pad < 1 << 16:
        raise ValueError("rows are at most 65536 ids of 16 bits")
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(source.dtypes)["key"]
    packed = source.mapInArrow(partial(_pack, path=vocabulary, pattern=pattern, length=length, pad=pad, pool=pool), f"n_tokens bigint, doc_ids array<{kind}>, doc_offsets array<bigint>, cu_seqlens array<bigint>, input_ids binary, position_ids binary")
    return packed.select(F.monotonically_increasing_id().alias("pack"), "*")
