"""Vectorised scans of UTF-8 text columns: words, 64-bit word hashes and windows.

Everything works on the flat byte buffer of an Arrow column. Texts are handled in
slices of a few megabytes, so that memory stays level whatever the partition holds;
one text longer than a slice is hashed piecewise, and never cut inside a word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of `[^\x20\x09-\x0D]`.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[32] = NON_SPACE[9:14] = False


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = a.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


@functools.cache
def _trim():
    """The C library's call that gives back freed memory, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give back to the system what Arrow and numpy have freed, or workers that live on keep it, up to 64 MB each."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of at most about `limit` bytes of text, one row at least.

    What has been freed goes back to the system after every batch.
    """
    for batch in batches:
        release()
        if not batch.num_rows:
            continue
        _, off = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        del batch
    release()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting x in place; faster than numpy's own, which hashes."""
    x.sort()
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


_powers = np.ones(1, np.uint64)


def _pow(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


class Words:
    """Words of a slice: 64-bit hash, byte span and the first word of each row."""

    def __init__(self, hashes, starts, ends, first, data, off):
        self.hash, self.start, self.end, self.first, self.data, self.off = hashes, starts, ends, first, data, off

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that don't overlap and are in order."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _PIECE, "right")))
        s, n = start[i:j], end[i:j] - start[i:j]
        total = int(n.sum())
        at = np.cumsum(n) - n
        rel = np.arange(total) - np.repeat(at, n)
        src = rel + np.repeat(s, n)
        value = (data[src].astype(np.uint64) + np.uint64(1)) * _pow(int(n.max()))[rel]
        out[i:j] = mix(np.add.reduceat(value, at) + n.astype(np.uint64))
        i = j
    return out


def words(column, keep: np.ndarray) -> Words:
    """Words of every row of a column: maximal runs of bytes in `keep`, A-Z lower-cased."""
    raw, off = flat(column)
    data = LOWER[raw]
    inside = keep[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    begins[heads] |= inside[heads]
    stops = ~inside
    start = np.flatnonzero(begins)
    # A word ends before the next byte that is outside, or where its row ends.
    outside = np.flatnonzero(stops)
    k = np.searchsorted(outside, start)
    end = np.where(k < len(outside), outside[np.minimum(k, len(outside) - 1)] if len(outside) else len(data), len(data))
    row_end = off[np.searchsorted(off, start, "right")]
    end = np.minimum(end, row_end)
    first = np.searchsorted(start, off)
    return Words(hash_spans(data, start, end), start, end, first, data, off)


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words inside one row, and the index of each one's first word."""
    count = len(w.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row_last = np.repeat(w.first[1:], np.diff(w.first))[:count]
    at = np.arange(count)
    value = np.zeros(count, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            value += w.hash[j : j + count] * factor
            factor = factor * np.uint64(0xD6E8FEB86659FD93)
    ok = at + n <= row_last
    return mix(value[ok] + np.uint64(n)), at[ok]
