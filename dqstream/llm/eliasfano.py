"""Elias-Fano coding of a sorted sequence of non-negative integers.

Each value is cut into `low` bits, stored as they are, and a rest, stored as the
gaps of a bit string in unary: about two bits and `low` bits per value, against
64 bits for a plain table. Positions of every SAMPLE-th one bit allow random
access without reading the whole bit string.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAMPLE = 256


@dataclass(frozen=True)
class EliasFano:
    n: int
    low: int
    lows: bytes
    highs: bytes
    samples: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """`values` must be sorted and not negative; repeats are allowed."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n == 0:
            return cls(0, 0, b"", b"", b"")
        low = max(0, (int(values[-1]) // n).bit_length() - 1)
        bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(
            n,
            low,
            np.packbits(bits.ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            ones[::SAMPLE].astype("<u4").tobytes(),
        )

    def all(self) -> np.ndarray:
        if self.n == 0:
            return np.zeros(0, np.int64)
        high = np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little")
        rest = np.flatnonzero(high)[: self.n] - np.arange(self.n)
        return (rest << self.low) | self._low(0, self.n)

    def select(self, i: int) -> int:
        """The value at position i, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        while True:
            piece = np.frombuffer(self.highs[byte : byte + 64], np.uint8)
            ones = np.flatnonzero(np.unpackbits(piece, bitorder="little")) + byte * 8
            ones = ones[ones >= at]
            if left < len(ones):
                return int((int(ones[left]) - i) << self.low | int(self._low(i, i + 1)[0]))
            left, byte = left - len(ones), byte + 64

    def _low(self, start: int, end: int) -> np.ndarray:
        if not self.low:
            return np.zeros(end - start, np.int64)
        first = start * self.low // 8
        raw = np.frombuffer(self.lows[first : (end * self.low + 7) // 8], np.uint8)
        bits = np.unpackbits(raw, bitorder="little")[start * self.low - first * 8 :]
        bits = bits[: (end - start) * self.low].reshape(-1, self.low).astype(np.int64)
        return bits @ (np.int64(1) << np.arange(self.low, dtype=np.int64))
