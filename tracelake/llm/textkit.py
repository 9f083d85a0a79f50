"""NumPy helpers that tasks use on slices of an Arrow batch: bytes of many texts at once, hashes of words and windows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: A task holds some twenty numbers of 64 bits for each byte of a slice: about 40 MB.
SLICE_BYTES = 256 << 10
U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits depend on all bits (the finaliser of SplitMix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed * 1_000_003)) * U64(0x9E3779B97F4A7C15))


BASE = int(numbers(1, 7)[0]) | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = numbers(256, 11)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        x = np.full(n, base, dtype=U64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(19, int(n).bit_length()))


class Prefix:
    """Hashes of any stretch [start, end) of a byte array in constant time each: a polynomial over 64-bit numbers."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Also depends on the length, so stretches of different lengths differ."""
        return mix64((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes of these texts as one array, offsets of the texts in it), without copies.

    A slice holds up to ``most`` bytes, or one text if that is longer; null texts are empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if n and column.buffers()[2] else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WORD_FACTORS = numbers(5, 23) | U64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, A-Z lower-cased, and offsets of the texts among them."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    gap = _SPACE[data]
    first = ~gap
    first[1:] &= gap[:-1]
    last = ~gap
    last[:-1] &= gap[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = ~gap[edge]
    last[edge - 1] = ~gap[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Prefix(_LOWER[data]).hashes(start, end), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text, the sorted hashes of its distinct shingles of ``width`` words.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    words, at = word_hashes(data, offsets)
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=U64)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * WORD_FACTORS[j]
    rolled = mix64(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield mix64((words[a:b] * WORD_FACTORS[: b - a]).sum(keepdims=True) + U64(b - a))
        else:
            yield np.zeros(0, U64)


def set_hash(values: np.ndarray) -> int:
    """A signed 64-bit hash of a set of 64-bit hashes."""
    x = mix64(np.array([values.sum(dtype=U64), np.bitwise_xor.reduce(values) + U64(len(values))], dtype=U64))
    return int(mix64(x[:1] + x[1:] * U64(0x9E3779B97F4A7C15)).view(np.int64)[0])
