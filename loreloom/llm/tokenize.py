"""Fast token ids of text columns: vectorised splitting and a bounded cache of pieces."""

from __future__ import annotations

import numpy as np
import tiktoken

from loreloom.llm import pieces
from loreloom.llm import textscan as ts
from loreloom.llm.bpe import load_ranks

REMEMBER = 1 << 20


class PieceEncoder:
    """Encodes columns with a .tiktoken vocabulary; each distinct piece is encoded once until the cache is full."""

    def __init__(self, path: str, pattern: str, remember: int = REMEMBER):
        tokens = load_ranks(path)
        self.n_ids = len(tokens)
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.off = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column, and where each row's begin; a null has none."""
        if len(self.known) > self.remember:
            self._forget()
        data, off = ts.flat(column)
        starts, first = pieces.split(data, off)
        unique, index, inverse = np.unique(pieces.piece_hashes(data, starts), return_index=True, return_inverse=True)
        ends = np.append(starts[1:], len(data))
        new = []
        for i, h in enumerate(unique.tolist()):
            if h not in self.known:
                self.known[h] = len(self.known)
                at = index[i]
                new.append(self.library.encode_ordinary(data[starts[at] : ends[at]].tobytes().decode()))
        if new:
            self.flat = np.concatenate([self.flat, np.array([x for ids in new for x in ids], np.int32)])
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum([len(x) for x in new])])
        at = np.fromiter((self.known[h] for h in unique.tolist()), np.int64, len(unique))[inverse]
        n = self.off[at + 1] - self.off[at]
        stop = np.cumsum(n)
        ids = self.flat[np.repeat(self.off[at] - (stop - n), n) + np.arange(int(stop[-1]) if len(stop) else 0)]
        return ids, np.concatenate([[0], stop])[first]
