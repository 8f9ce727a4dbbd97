"""Words, word hashes and shingle hashes of many texts at once, on the raw UTF-8 bytes of an Arrow column.

Hashes only ever propose; every user compares the words themselves afterwards, or keeps 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` of lower-cased text: digits, a-z and every byte of other characters.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def hash_runs(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive non-empty runs of ``data`` (equal bytes, equal hashes)."""
    if len(sizes) == 0:
        return np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    powers = np.cumprod(np.full(int(sizes.max()) + 1, _MULTIPLIER), dtype=np.uint64)
    inside = np.arange(len(data), dtype=np.int64) - np.repeat(starts, sizes)
    terms = (data + np.uint64(1)) * powers[inside]
    return mixed(np.add.reduceat(terms, starts) + sizes.astype(np.uint64))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its rows in them; null counts as empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """Words of all rows in order: their bounds in ``data``, hashes, and the first word of each row."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    firsts: np.ndarray  # one more than rows

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.firsts) - 1), np.diff(self.firsts))

    def text(self, a: int, b: int) -> list[str]:
        return [bytes(self.data[s:e]).decode() for s, e in zip(self.starts[a:b], self.ends[a:b])]

    def shingles(self, size: int, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``size`` words of a row, and their first words."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        total = np.full(n, size, np.uint64)
        for j in range(size):
            total = total * _MULTIPLIER + self.hashes[j : j + n]
        first = np.flatnonzero(row[:n] == row[size - 1 :])
        return mixed(total[first]), first


def words(column: pa.Array) -> Words:
    """Lower-case A-Z and cut into maximal runs of word bytes."""
    data, bounds = raw(column)
    data = _LOWER[data]
    inside = _IN_WORD[data]
    fresh = np.ones(len(data) + 1, bool)  # no word continues here
    fresh[1:] = ~np.append(inside[:-1], False) if len(data) else True
    fresh[bounds] = True
    starts = np.flatnonzero(inside & fresh[:-1])
    last = np.ones(len(data), bool)
    if len(data):
        last = ~np.append(inside[1:], False)
        last[bounds[1:][bounds[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    hashes = hash_runs(data[inside].astype(np.uint64), ends - starts)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds))
