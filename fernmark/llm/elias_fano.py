"""Elias-Fano code of a non-decreasing sequence, with a select structure.

Layout, little-endian: n (u32), low bits l (u8), universe (u64), number of
upper words (u32), the lower bits packed to bytes, the upper bits as 64-bit
words, then one u32 for every 256th set bit (its position), which lets
``select`` start close by; ``select_many`` finds many at once. About 2 + log2(universe / n) bits an element.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<IBQI")
_STEP = 256
#: Set bits of each byte, and the place of its k-th.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_COUNT = _BITS.sum(axis=1).astype(np.uint8)
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable")


def encode(values: np.ndarray) -> bytes:
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    universe = int(values[-1]) + 1 if n else 1
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    lower = b""
    if low and n:
        bits = (values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        lower = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    words = (int(ones[-1]) // 64 + 1) if n else 0
    upper = np.zeros(words * 64, dtype=np.uint8)
    upper[ones] = 1
    packed = np.packbits(upper, bitorder="little").tobytes()
    samples = ones[::_STEP].astype("<u4").tobytes()
    return _HEAD.pack(n, low, universe, words) + lower + packed + samples


class EliasFano:
    """A view over encoded bytes."""

    def __init__(self, data: bytes):
        self.n, self.low, self.universe, words = _HEAD.unpack_from(data)
        at = _HEAD.size
        size = (self.n * self.low + 7) // 8
        self._lower = np.frombuffer(data, np.uint8, size, at)
        self._upper = np.frombuffer(data, np.uint8, words * 8, at + size)
        self._samples = np.frombuffer(data, "<u4", -(-self.n // _STEP), at + size + words * 8)
        self._upto: np.ndarray | None = None

    def _low_bits(self, i: int) -> int:
        at, value = i * self.low, 0
        for k in range(self.low):
            b = at + k
            value |= ((int(self._lower[b >> 3]) >> (b & 7)) & 1) << k
        return value

    def select(self, i: int) -> int:
        """Element i, from the nearest sampled set bit on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        pos, left = int(self._samples[i // _STEP]), i % _STEP
        if left:
            start = pos + 1
            while True:
                byte = int(self._upper[start >> 3]) >> (start & 7)
                ones = byte.bit_count()
                if left > ones:
                    left -= ones
                    start = (start | 7) + 1
                    continue
                while left:
                    if byte & 1:
                        left -= 1
                        pos = start
                    byte >>= 1
                    start += 1
                break
        return ((pos - i) << self.low) | self._low_bits(i)

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """Elements at several places: the byte with each one's set bit by a search in the running counts of bytes, the bit by a table."""
        at = np.asarray(at, np.int64)
        if len(at) and not (0 <= at.min() and at.max() < self.n):
            raise IndexError("place out of range")
        if self._upto is None:
            self._upto = np.cumsum(_COUNT[self._upper], dtype=np.int64)
        byte = np.searchsorted(self._upto, at, side="right")
        inside = at - (self._upto[byte] - _COUNT[self._upper[byte]])
        high = byte * 8 + _PLACE[self._upper[byte], inside] - at
        if not self.low:
            return high
        bit = (at * self.low)[:, None] + np.arange(self.low)
        low = (self._lower[bit >> 3] >> (bit & 7).astype(np.uint8)) & np.uint8(1)
        return (high << self.low) | (low.astype(np.int64) << np.arange(self.low)).sum(axis=1)

    def decode(self) -> np.ndarray:
        """All elements."""
        ones = np.flatnonzero(np.unpackbits(self._upper, bitorder="little")).astype(np.int64)
        high = ones - np.arange(self.n)
        if not self.low:
            return high
        bits = np.unpackbits(self._lower, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        return (high << self.low) | (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1)
