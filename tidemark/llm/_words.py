"""Words of whole Arrow text batches as numpy arrays, with hashes that agree on every machine.

A word is a maximal run of bytes other than space and \\x09-\\x0D, so words never split a
UTF-8 sequence. Its hash is a polynomial over random byte codes modulo 2**64; prefix sums make
the hash of any byte or word range a subtraction and a multiplication.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 2 << 20  # text that is worked on at once; the arrays take some 40 times as much
_BASE = pow(6364136223846793005, 3, 2**64)
WORD_BASE = pow(2862933555777941757, 5, 2**64)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser with good bits in every place."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, base, U), dtype=U)])


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    return _powers(base, 1 << max(16, (n - 1).bit_length()))[:n]


def codes(seed: int, lower: bool = False) -> np.ndarray:
    table = mixed(np.arange(256, dtype=U), seed) | U(1)
    if lower:
        table[65:91] = table[97:123]
    return table


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Ranges:
    """Hashes of any [start, end) ranges of a sequence of 64-bit codes."""

    sums: np.ndarray
    base: int

    @classmethod
    def of(cls, values: np.ndarray, base: int) -> Ranges:
        sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * powers(base, max(1, len(values)))[: len(values)], out=sums[1:])
        return cls(sums, base)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = powers(pow(self.base, -1, 2**64), max(1, len(self.sums)))
        return (self.sums[end] - self.sums[start]) * inverse[start]


@dataclass
class Words:
    """Words of the texts of a slice, in order."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of each text, one more than texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # index of the first word of each text, one more than texts

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_index(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.count)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return mixed(Ranges.of(codes(seed)[self.data], _BASE).hashes(self.start, self.end))


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    inside = ~space[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    starts[edges] = inside[edges]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start = np.flatnonzero(starts)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    at = np.arange(n)
    return mixed(Ranges.of(values, WORD_BASE).hashes(at, at + width), width)


def shingles(w: Words, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and the first such hash of each text.

    A text of fewer words has one shingle, of all its words; one without words has none.
    """
    h, count = w.hashes(seed), w.count
    per_text = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    first = np.concatenate([[0], np.cumsum(per_text)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], per_text) + np.repeat(w.first[:-1], per_text)
    length = np.repeat(np.minimum(count, size), per_text)
    out = mixed(Ranges.of(h, WORD_BASE).hashes(at, at + length) + length.astype(U), size)
    return out, first


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of parts of about ``limit`` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
