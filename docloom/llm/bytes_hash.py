"""Prefix polynomial hashes of byte strings, vectorised over whole batches."""

from __future__ import annotations

import numpy as np

# An odd base has an inverse modulo 2**64; the tables below are the fixed rule of the hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_MARKS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def powers(count: int, inverse: bool = False) -> np.ndarray:
    """The first ``count`` powers of the base, or of its inverse."""
    known = _POWERS.get(str(inverse))
    if known is None or len(known) < count:
        steps = np.full(max(count, 1 << 16), INVERSE if inverse else BASE, np.uint64)
        steps[0] = 1
        known = _POWERS[str(inverse)] = np.multiply.accumulate(steps)
    return known[:count]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class PrefixHash:
    """Hash of any substring of a byte array in constant time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_MARKS[data] * powers(len(data)), out=self._sums[1:])
        self._back = powers(len(data) + 1, inverse=True)

    def of(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """Hash of data[start : start + length] for arrays of starts."""
        return (self._sums[starts + lengths] - self._sums[starts]) * self._back[starts]

    def every(self, length: int) -> np.ndarray:
        """Hash of the ``length`` bytes from every start."""
        return (self._sums[length:] - self._sums[:len(self._sums) - length]) * self._back[:len(self._sums) - length]
