"""Hashes of stretches of text, for whole Arrow batches at once.

Prefix sums of random byte values times powers of an odd base, modulo 2^64, give the hash of any stretch by one subtraction
and one product, as an odd base has an inverse. A final mix spreads the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; it bounds memory and changes no result.
SLICE_BYTES = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


@cache
def _byte_values(which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[which]) + np.uint64(which))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse."""
    if which not in _powers or len(_powers[which][0]) < n:
        both = []
        for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[:1] = 1
            both.append(np.multiply.accumulate(x))
        _powers[which] = (both[0], both[1])
    return _powers[which]


class PrefixHash:
    """Hashes of stretches [start, end) of ``data``; equal bytes hash alike wherever they stand, in any batch."""

    def __init__(self, data: np.ndarray, which: int = 0):
        power, self.inverse = _powers_of(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values(which)[data] * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        """The hash of each stretch of ``length`` bytes, by its start."""
        n = max(0, len(self.sums) - length)
        return mix((self.sums[length:] - self.sums[:n]) * self.inverse[:n] + np.uint64(length))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end and the offsets of its texts; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of texts of about ``size`` bytes together, one text at least."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last
        first = last
