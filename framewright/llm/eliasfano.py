"""Elias-Fano sequences: sorted numbers in about 2 + log2(universe / n) bits each, searched where they lie.

The low bits of every number stand in one packed array, the high bits in another in unary. Both may be memory-mapped:
a search touches only the places it needs of the low bits.
"""

from __future__ import annotations

import numpy as np

_MAX_LOW = 56


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits one after the other, with room to read eight bytes anywhere."""
    out = []
    for a in range(0, len(values), 1 << 16):
        part = values[a : a + (1 << 16), None] >> np.arange(bits, dtype=np.uint64)
        out.append((part & np.uint64(1)).astype(np.uint8).ravel())
    flat = np.packbits(np.concatenate(out), bitorder="little") if out and bits else np.zeros(0, np.uint8)
    return np.concatenate([flat, np.zeros(8, np.uint8)])


class EliasFano:
    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._words = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        self._mask = np.uint64((1 << bits) - 1)
        # The first number of each value of the high bits: a running count over the unary code.
        ones = np.unpackbits(high, bitorder="little")
        self._first = np.concatenate([[0], np.flatnonzero(ones == 0) - np.arange(len(ones) - int(ones.sum()))])

    @classmethod
    def of(cls, values: np.ndarray, universe: int | None = None) -> EliasFano:
        """Of numbers in ascending order, all below the universe."""
        values = values.astype(np.uint64)
        n = len(values)
        universe = max(int(universe if universe is not None else (int(values[-1]) + 1 if n else 1)), 1)
        bits = min(_MAX_LOW, max(0, (universe // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(bits)).astype(np.int64)
        marks = np.zeros(n + ((universe - 1) >> bits) + 1, np.uint8)
        marks[high + np.arange(n)] = 1
        return cls(n, bits, _pack(values & np.uint64((1 << bits) - 1), bits), np.packbits(marks, bitorder="little"))

    def lows(self, at: np.ndarray) -> np.ndarray:
        place = at * self.bits
        return (self._words[place >> 3] >> (place & 7).astype(np.uint64)) & self._mask

    def decode(self) -> np.ndarray:
        """All numbers."""
        marks = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (marks - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self.lows(np.arange(self.n))

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at these places."""
        high = np.searchsorted(self._first, at, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.bits)) | self.lows(at)

    def locate(self, queries: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each number, -1 where it is absent; looked for only from ``begin`` up to ``end`` where given."""
        queries = queries.astype(np.uint64)
        out = np.full(len(queries), -1, np.int64)
        if not self.n or not len(queries):
            return out
        high = queries >> np.uint64(self.bits)
        known = high < np.uint64(len(self._first) - 1)
        high = np.where(known, high, np.uint64(0)).astype(np.int64)
        lo = self._first[high]
        hi = np.where(known, np.minimum(self._first[high + 1], self.n), lo)
        if begin is not None:
            lo, hi = np.maximum(lo, begin), np.minimum(hi, end)
        want = queries & self._mask
        left = np.flatnonzero(lo < hi)
        while len(left):
            mid = (lo[left] + hi[left]) >> 1
            got, own = self.lows(mid), want[left]
            hit = got == own
            out[left[hit]] = mid[hit]
            lo[left] = np.where(got < own, mid + 1, lo[left])
            hi[left] = np.where(got < own, hi[left], mid)
            left = left[~hit]
            left = left[lo[left] < hi[left]]
        return out

    def blobs(self) -> tuple[dict[str, int], list[np.ndarray]]:
        return {"n": self.n, "bits": self.bits}, [self.low, self.high]
