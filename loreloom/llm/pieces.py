"""Vectorised form of the public pre-tokenisation pattern of byte-level BPE vocabularies.

The pattern is  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ .
Its matches tile a text, and where they begin follows from the classes of neighbouring
characters, so that no regular expression has to run.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from loreloom.llm import textscan as ts

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def split(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pieces begin, and each row's first piece; data and off as of textscan.flat."""
    n_rows = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n_rows + 1, np.int64)
    c = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(c)
    heads = np.searchsorted(at, off[:-1][off[:-1] < off[1:]])
    kind = classes()[c]
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    row_head = np.zeros(n + 1, bool)
    row_head[heads] = row_head[n] = True
    run |= row_head[:n]
    begin = run.copy()
    # The last of some spaces before another run in the same row joins it if it is U+0020, and else stands alone.
    after = np.flatnonzero(run[1:] & ~row_head[1:n] & (kind[:-1] == SPACE)) + 1
    begin[after - 1] = True
    begin[after[c[after - 1] == 0x20]] = False
    # Contractions begin with an apostrophe that is a run of its own and has no space before it.
    ap = np.flatnonzero((c[:-1] == 0x27) & begin[:-1] & run[:-1] & (kind[1:] == LETTER) & ~row_head[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(ap):
        nxt = c[ap + 1]
        one = ap[np.isin(nxt, [ord(x) for x in "stmd"])]
        has = ap[(ap + 2 < n)]
        has = has[~row_head[has + 2]]
        pair = np.stack([c[has + 1], c[has + 2]], 1)
        two = has[np.isin(pair[:, 0] * np.uint32(65536) + pair[:, 1], [ord(x[0]) * 65536 + ord(x[1]) for x in ("re", "ve", "ll")])]
        for found, k in ((one, 2), (two, 3)):
            begin[found + 1] = False
            rest = found[found + k < n] + k
            begin[rest[~run[rest]]] = True
    starts = at[begin]
    return starts, np.searchsorted(starts, off)


def piece_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return ts.hash_spans(data, starts, np.append(starts[1:], len(data)))
