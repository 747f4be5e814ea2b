"""Minimal perfect hashing of distinct 64-bit keys.

The keys are hashed into a bit array of GAMMA slots a key; those alone in their slot are placed
there and the others go on to the next, smaller level. A key's number is the count of placed slots
before its own, so n keys have the numbers 0 to n - 1. A key that is not of the set may get
any number: the keys are kept by number, and a lookup compares.
"""

from __future__ import annotations

import numpy as np

from .words import mix

GAMMA = 1.7
_MOST_LEVELS = 256


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix(keys ^ salt) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray, keys: np.ndarray | None = None):
        """`sizes`: slots of each level; `bits`: all levels' placed slots, packed."""
        self.sizes, self.bits = sizes, bits
        self._placed = np.unpackbits(bits, count=int(sizes.sum())).astype(bool)
        self._rank = np.cumsum(self._placed) - 1
        self.keys = keys

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """The function of distinct keys (uint64), with the keys by number."""
        left, sizes, levels = keys, [], []
        while len(left):
            if len(levels) == _MOST_LEVELS:
                raise ValueError("keys are not distinct")
            size = int(len(left) * GAMMA) + 8
            at = _slots(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        placed = np.concatenate(levels) if levels else np.zeros(0, bool)
        found = cls(np.array(sizes, np.int64), np.packbits(placed))
        found.keys = np.zeros(len(keys), np.uint64)
        found.keys[found._number(keys)] = keys
        return found

    def _number(self, keys: np.ndarray) -> np.ndarray:
        numbers = np.full(len(keys), -1, np.int64)
        left, first = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = first + _slots(keys[left], level, size)
            placed = self._placed[at]
            numbers[left[placed]] = self._rank[at[placed]]
            left = left[~placed]
            first += size
        return numbers

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 where the kept key tells that it is none of the set."""
        numbers = self._number(keys)
        if not len(self.keys):
            return numbers
        return np.where((numbers >= 0) & (self.keys[numbers] == keys), numbers, -1)
