"""Words of whole texts, cut and hashed by numpy over Arrow's own buffers.

A byte has a class: 0 ends a word, and a word is a run of bytes of one other class. A word's 64-bit hash is a
polynomial over its folded bytes, taken from one running sum, so it does not depend on where the word stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from .common import doc_ranges, string_buffers

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
PIECE = 1 << 19


def classes(*runs: str | bytes | range) -> np.ndarray:
    """Class table: the bytes of the n-th argument have class n, all others class 0."""
    out = np.zeros(256, np.uint8)
    for n, run in enumerate(runs, 1):
        out[list(run.encode() if isinstance(run, str) else run)] = n
    return out


def lower_ascii() -> np.ndarray:
    out = np.arange(256)
    out[65:91] += 32
    return out.astype(np.uint8)


NOT_SPACE = classes([b for b in range(256) if b != 0x20 and not 9 <= b <= 13])
LETTERS_DIGITS = classes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """The words of the rows [lo, hi) of a column: byte positions in `data`, hashes, and how many each row has."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


@dataclass
class Cutter:
    table: np.ndarray
    fold: np.ndarray | None = None
    piece: int = PIECE
    _value: np.ndarray = field(init=False, repr=False)
    _up: np.ndarray = field(init=False, repr=False)
    _down: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self._value = (np.arange(256) if self.fold is None else self.fold).astype(np.uint64) + np.uint64(1)
        self._up = self._down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            n = max(n, self.piece + 1)
            for name, base in (("_up", _BASE), ("_down", _BASE_INVERSE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def _cut(self, data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word starts, ends and hashes in `data`; `firsts` are the places where a new text begins."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        kind = self.table[data]
        change = np.empty(n, bool)
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        change[firsts[firsts < n]] = True
        at = np.flatnonzero(change)
        ends = np.append(at[1:], n)
        real = kind[at] != 0
        starts, ends = at[real], ends[real]
        self._powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self._value[data] * self._up[:n], out=total[1:])
        return starts, ends, mix((total[ends] - total[starts]) * self._down[starts])

    def _pieces(self, data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """A long text in pieces that end where no word does, so that no word is cut."""
        while lo < hi:
            end = min(lo + self.piece, hi)
            if end < hi:
                gaps = np.flatnonzero(self.table[data[lo:end]] == 0)
                if len(gaps):
                    end = lo + int(gaps[-1]) + 1
                else:
                    while end < hi and self.table[data[end]]:
                        end += 1
            yield lo, end
            lo = end

    def words(self, column: pa.Array) -> Iterator[Words]:
        data, offsets = string_buffers(column)
        for lo, hi in doc_ranges(offsets, self.piece):
            a, b = int(offsets[lo]), int(offsets[hi])
            parts = [(a, b)] if b - a <= self.piece else list(self._pieces(data, a, b))
            firsts = offsets[lo:hi] - a if len(parts) == 1 else np.zeros(1, np.int64)
            found = [(p, self._cut(data[p:q], firsts)) for p, q in parts]
            starts = np.concatenate([p + f[0] for p, f in found]) if found else np.zeros(0, np.int64)
            ends = np.concatenate([p + f[1] for p, f in found]) if found else np.zeros(0, np.int64)
            hashes = np.concatenate([f[2] for _, f in found]) if found else np.zeros(0, np.uint64)
            counts = np.diff(np.searchsorted(starts, offsets[lo : hi + 1]))
            yield Words(lo, hi, data, starts, ends, hashes, counts)
