"""Vectorised words and rolling hashes over Arrow string columns.

A word is a maximal run of bytes outside a separator class. All hashes are
64-bit polynomials modulo 2**64 over random tables with odd bases, taken from
prefix sums, so a whole block of texts costs a fixed number of numpy passes.
Texts are cut into blocks of BLOCK bytes (one text at least), which bounds the
memory of a Python worker by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything that is neither a letter, a digit nor part of a multi-byte character.
PUNCT = np.array([not (chr(b).isascii() and chr(b).isalnum()) and b < 0x80 for b in range(256)])
_rng = np.random.default_rng(0x10C0)
BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
_BASE_B, _BASE_W = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            grow = lambda b: np.cumprod(np.concatenate([[U(1)], np.full(size - 1, b, U)]), dtype=U)
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up[:n], self.down[:n]


_B, _W = _Powers(_BASE_B), _Powers(_BASE_W)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ U(salt)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of a block of texts: byte bounds in data, hashes, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1 offsets into the words
    sums: np.ndarray  # prefix sums of the bytes' polynomial

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash of its first n bytes) of the words longer than n bytes."""
        at = np.flatnonzero(self.end - self.start > n)
        start = self.start[at]
        return at, mix((self.sums[start + n] - self.sums[start]) * _B.get(len(self.data) + 1)[1][start], 0x9F + n)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that run past the block are left out."""
        n = len(self.hash)
        if n < k:
            return np.empty(0, U)
        up, down = _W.get(n + 1)
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum(self.hash * up[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1], k)

    def span(self, a: int, b: int) -> int:
        """Hash of words a to b (b not included), as grams(b - a) has it."""
        up, _ = _W.get(b - a + 1)
        raw = np.add.reduce(self.hash[a:b] * up[: b - a], dtype=U) if b > a else U(0)
        return int(mix(np.array([raw], U), b - a)[0])


def split(texts: pa.Array, table: np.ndarray = BYTES, sep: np.ndarray = SPACE) -> Words:
    """The words of each text (null: none)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, stop = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[base:stop] if stop > base else np.empty(0, np.uint8)
    bounds = offsets - base
    n = len(data)
    inside = ~sep[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside
    ends[:-1] = inside[:-1] & (~inside[1:] | edge[1:n]) if n else ends[:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _B.get(n + 1)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum(table[data] * up[:n], out=sums[1:])
    raw = (sums[end] - sums[start]) * down[start]
    return Words(data, start, end, mix(raw), np.searchsorted(start, bounds), sums)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with at most limit bytes of text, or one row."""
    sizes = np.zeros(len(batch), np.int64) + 1
    lengths = pc.binary_length(batch.column(column)).fill_null(0)
    sizes += np.asarray(lengths, dtype=np.int64)
    at = 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
