"""Byte-level BPE by Spark higher-order functions.

The ranks of a vocabulary file become a literal map in the plan: merging tokens a and b is
one look-up at `shift[a] + b` in a table whose entries name their a (row displacement, a
perfect hash). A fold over the byte array of each distinct word merges the pair of lowest
rank, leftmost first, until no pair has a rank. No text is shuffled and nothing that grows
with the corpus is broadcast:

    texts -> words of the pattern, distinct in the partition   (Arrow, vectorised)
          -> fold over every new distinct word                  (higher-order functions)
          -> each text's ids from its words' ids                (Arrow, vectorised)
          -> decoded bytes, by concatenating binary pieces      (Arrow, or higher-order functions)

A row between the first two steps carries the words that its slice of texts is first in the
partition to use; the third step runs in the same task over the same rows in the same
order, and keeps them. A retried task repeats all of it from its input.

Words longer than `LONG` bytes (runs of one class of characters without a break) would make
the fold quadratic; they are merged by the same rule with a heap, in the first step.

Defined cases: a null text is empty and has no ids; repeated rows are encoded each; a null
key stays null; columns with clashing names are never read.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm import pieces
from loreloom.llm import textscan as ts

LONG = 256
#: Above every rank of the vocabularies this is for.
LIMIT = 1 << 17
_WINDOW = 1 << 15


@functools.cache
def load_ranks(path: str) -> list[bytes]:
    """Tokens by id of a .tiktoken file."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) >= LIMIT:
        raise ValueError(f"{len(ranks)} tokens; at most {LIMIT - 1} are possible")
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


@functools.cache
def pair_table(path: str) -> tuple[list[int], list[int], list[int]]:
    """(ids of single bytes, shift by left token, entries left * LIMIT + merged rank) of all pairs that merge."""
    tokens = load_ranks(path)
    rank = {t: i for i, t in enumerate(tokens) if t}
    rows: dict[int, dict[int, int]] = {}
    for token, merged in rank.items():
        for k in range(1, len(token)):
            left, right = rank.get(token[:k]), rank.get(token[k:])
            if left is not None and right is not None:
                rows.setdefault(left, {})[right] = merged
    shift, used = [0] * len(tokens), np.zeros(1 << 21, bool)
    entries = np.full(len(used), -1, np.int64)
    for left in sorted(rows, key=lambda a: (-len(rows[a]), a)):
        right = np.array(sorted(rows[left]), np.int64)
        for window in range(0, len(used), _WINDOW):
            taken = np.zeros(_WINDOW, bool)
            for r in right:
                taken |= used[window + r : window + r + _WINDOW]
            at = window + int(np.argmin(taken))
            if not taken[at - window]:
                break
        used[at + right] = True
        entries[at + right] = left * LIMIT + np.array([rows[left][int(b)] for b in right])
        shift[left] = at
    size = int(np.flatnonzero(used)[-1]) + 1
    return [rank[bytes([b])] for b in range(256)], shift, entries[:size].tolist()


def merge_long(word: bytes, table: tuple[list[int], list[int], list[int]]) -> list[int]:
    """The same merges with a heap, for long words."""
    single, shift, entries = table
    ids = [single[b] for b in word]
    after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))

    def rank(a: int, b: int) -> int:
        at = shift[a] + b
        found = entries[at] - a * LIMIT if 0 <= at < len(entries) else -1
        return found if 0 <= found < LIMIT else LIMIT

    heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(ids[i], ids[i + 1])) < LIMIT]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= len(ids) or ids[j] != b:
            continue
        ids[i], ids[j] = r, -1
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
            if (x := rank(r, ids[after[i]])) < LIMIT:
                heapq.heappush(heap, (x, i, r, ids[after[i]]))
        if before[i] >= 0 and (x := rank(ids[before[i]], r)) < LIMIT:
            heapq.heappush(heap, (x, before[i], ids[before[i]], r))
    return [x for x in ids if x >= 0]


def _literal(values: list, kind: str) -> str:
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


def fold_words(words: str, path: str) -> Column:
    """array<array<int>> of ids for array<binary-like array<int>> `words`: one fold for each word."""
    single, shift, entries = pair_table(path)
    # An element is rank of the pair that begins here (LIMIT: none) << 37 | its place << 17 | token, so that the least element is the next to merge.
    top, low = 37, LIMIT - 1
    rank = lambda a, b: f"shiftleft(least((get(t.entries, get(t.shift, {a}) + {b}) - {a} * {LIMIT}L) & {(1 << 63) - 1}L, {LIMIT}L), {top})"
    token = lambda v: f"cast({v} & {low}L as int)"
    merged = f"cast(shiftright(m, {top}) as int)"
    at_pair = f"{rank(merged, token('get(x, j + 2)'))} | (m & {((1 << top) - 1) ^ low}L) | shiftright(m, {top})"
    before = f"{rank(token('v'), merged)} | (v & {(1 << top) - 1}L)"
    spliced = f"filter(transform(x, (v, i) -> if(abs(i - j) > 1, v, if(i = j, {at_pair}, if(i < j, {before}, cast(null as bigint))))), v -> v is not null)"
    step = f"transform(array(array_min(x)), m -> if(m >= {LIMIT << top}L, x, transform(array(cast(array_position(x, m) as int) - 1), j -> {spliced})[0]))[0]"
    start = f"transform(array(transform(w, b -> get(t.single, b))), s -> transform(s, (a, i) -> {rank('a', 'get(s, i + 1)')} | shiftleft(cast(i as bigint), 17) | a))[0]"
    fold = f"transform({words}, w -> aggregate(slice(w, 2, size(w)), {start}, (x, i) -> {step}, x -> transform(x, v -> {token('v')})))"
    table = f"named_struct('single', {_literal(single, 'int')}, 'shift', {_literal(shift, 'int')}, 'entries', {_literal(entries, 'bigint')})"
    return F.expr(f"transform(array({table}), t -> {fold})[0]")


#: Distinct words that a task remembers before it starts anew.
REMEMBER = 1 << 20
#: Bytes of text of a row between the steps. Rows of many MB each are large blocks of an executor's heap, which grows for them.
SLICE_BYTES = 1 << 19


def _words_of(key: str, text: str, table, remember: int, slice_bytes: int):
    """A row for each slice of texts: keys, pieces a text, the pieces as indexes of words, and words not seen before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in ts.slices(batches, text, slice_bytes):
            data, off = ts.flat(batch.column(text))
            starts, first = pieces.split(data, off)
            unique, index, inverse = np.unique(pieces.piece_hashes(data, starts), return_index=True, return_inverse=True)
            anew = len(known) > remember
            if anew:
                known.clear()
            ends = np.append(starts[1:], len(data))
            new = [(i, h) for i, h in enumerate(unique.tolist()) if h not in known]
            at = index[[i for i, _ in new]] if new else np.zeros(0, np.int64)
            size = ends[at] - starts[at]
            # Short words come first, then the long ones, which are merged here.
            order = np.argsort(size > LONG, kind="stable")
            at, short = at[order], int((size <= LONG).sum())
            for k in order.tolist():
                known[new[k][1]] = len(known)
            local = np.fromiter((known[h] for h in unique.tolist()), np.int32, len(unique))
            lengths = ends[at[:short]] - starts[at[:short]]
            src = np.repeat(starts[at[:short]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(data[src].astype(np.int32)))
            done = [merge_long(data[starts[i] : ends[i]].tobytes(), table.value) for i in at[short:].tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(key).to_pylist()], pa.list_(batch.schema.field(key).type)),
                    pa.array([np.diff(first).tolist()], pa.list_(pa.int32())),
                    pa.array([local[inverse].tobytes()], pa.binary()),
                    pa.array([anew]),
                    pa.ListArray.from_arrays(pa.array([0, short], pa.int32()), words),
                    pa.array([done], pa.list_(pa.list_(pa.int32()))),
                ],
                names=["keys", "n", "at", "anew", "words", "done"],
            )

    return run


def _gather(flat: np.ndarray, off: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenation of the runs flat[off[i] : off[i + 1]] for i in at, and the end of each."""
    n = off[at + 1] - off[at]
    ends = np.cumsum(n)
    return flat[np.repeat(off[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def _assemble(key: str, tokens):
    """tokens: a broadcast list of each id's bytes where decoded texts are wanted too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokens is not None:
            binary = np.frombuffer(b"".join(tokens.value), np.uint8)
            begin = np.concatenate([[0], np.cumsum([len(t) for t in tokens.value])])
        flat, off = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("anew")[row].as_py():
                    flat, off = np.zeros(0, np.int32), np.zeros(1, np.int64)
                for name in ("words", "done"):
                    got = batch.column(name)[row].values
                    if len(got):
                        ids = got.flatten().to_numpy(zero_copy_only=False)
                        sizes = got.value_lengths().to_numpy(zero_copy_only=False)
                        off = np.concatenate([off, off[-1] + np.cumsum(sizes)])
                        flat = np.concatenate([flat, ids.astype(np.int32)])
                at = np.frombuffer(batch.column("at")[row].as_py(), np.int32)
                ids, ends = _gather(flat, off, at)
                rows = np.concatenate([[0], np.cumsum(batch.column("n")[row].values.to_numpy(zero_copy_only=False))])
                bounds = np.concatenate([[0], ends])[rows]
                out = {key: batch.column("keys")[row].values, "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))}
                if tokens is not None:
                    raw, ends = _gather(binary, begin, ids)
                    at = np.concatenate([[0], ends])[bounds].astype(np.int32)
                    out["decoded"] = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])

    return run


def encode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", decoded: bool = False, remember: int = REMEMBER, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """key and ids (array<int>) of every row; with `decoded` also the bytes that the ids stand for."""
    kind = dict(docs.dtypes)[key]
    table = docs.sparkSession.sparkContext.broadcast(pair_table(path))
    sliced = docs.select(key, text).mapInArrow(_words_of(key, text, table, remember, slice_bytes), f"keys array<{kind}>, n array<int>, at binary, anew boolean, words array<array<int>>, done array<array<int>>")
    folded = sliced.select("keys", "n", "at", "anew", fold_words("words", path).alias("words"), "done")
    tokens = docs.sparkSession.sparkContext.broadcast(load_ranks(path)) if decoded else None
    return folded.mapInArrow(_assemble(key, tokens), f"`{key}` {kind}, ids array<int>" + ", decoded binary" * decoded)


def decode(ids: str, path: str) -> Column:
    """The bytes of an id array: its tokens' bytes, concatenated."""
    names = ",".join(t.hex() for t in load_ranks(path))
    return F.expr(f"unhex(array_join(transform(array(split('{names}', ',')), t -> transform({ids}, i -> get(t, i)))[0], ''))")


def digests(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens and SHA-256 of the ids as text and of the decoded bytes."""
    encoded = encode(docs, path, key=key, text=text, decoded=True)
    return encoded.select(key, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
