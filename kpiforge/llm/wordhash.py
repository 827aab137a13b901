"""Words of texts as 64-bit hashes, and hashes of runs of words (numpy, used inside tasks).

A word is a run of bytes other than ASCII white space.  Its hash is a polynomial
in random byte values; whole blocks of texts are hashed at once, and texts longer
than a block are hashed piece by piece, cut at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_BASE = 0xBF58476D1CE4E5B9
_SPACES = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Bytes hashed at once.
_BLOCK = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _SHIFT)
    h = h * _MIX
    return h ^ (h >> _SHIFT)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each position (empty if there are fewer)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _MULT
        h += words[j : j + n]
    return mixed(h)


class WordHasher:
    """``lower`` hashes A-Z as a-z."""

    def __init__(self, lower: bool = False):
        values = mixed(mixed(np.arange(1, 257, dtype=np.uint64) * _MULT)) | np.uint64(1)
        values[_SPACES] = 0
        if lower:
            values[65:91] = values[97:123]
        self.values = values
        self._grow(_BLOCK)

    def _grow(self, n: int) -> None:
        steps = np.full(n, _BASE, np.uint64)
        back = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        steps[0] = back[0] = 1
        self.powers, self.inverse = np.cumprod(steps), np.cumprod(back)

    def _hash(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of ``data`` and where each starts; a word also ends at every cut."""
        if len(data) > len(self.powers):
            self._grow(len(data))
        space = _SPACES[data]
        first = ~space
        first[1:] &= space[:-1]
        inner = cuts[cuts < len(data)]
        first[inner] = ~space[inner]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.empty(0, np.uint64), starts
        sums = np.add.reduceat(self.values[data] * self.powers[: len(data)], starts)
        return mixed(sums * self.inverse[starts]), starts

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Word hashes of one text of any length."""
        out, at = [], 0
        while at < len(data):
            end = at + _BLOCK
            while end < len(data) and not (gap := np.flatnonzero(_SPACES[data[at + 1 : end]])).size:
                end += _BLOCK  # a word longer than a block
            end = len(data) if end >= len(data) else at + 1 + int(gap[-1])
            out.append(self._hash(data[at:end], np.empty(0, np.int64))[0])
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The word hashes of each text of a column without NULLs."""
        column = column.cast(pa.large_binary())
        if not len(column):
            return
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(at, at[i] + _BLOCK, "right")) - 1)
            if at[j] - at[i] > _BLOCK:
                yield self._long(raw[at[i] : at[j]])
            else:
                bounds = at[i : j + 1] - at[i]
                hashes, starts = self._hash(raw[at[i] : at[j]], bounds[:-1])
                ends = np.searchsorted(starts, bounds)
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                    yield hashes[a:b]
            i = j
