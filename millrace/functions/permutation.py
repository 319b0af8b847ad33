"""Keyed permutations of 0..n-1 that are computed, not sorted.

A Feistel network over pairs (left, right) with left < a and right < b, where
a * b is n or little more: rounds add a keyed hash of one half to the other.
What falls on n or beyond is sent through again until it lies below n (cycle
walking), which keeps it a permutation.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np

ROUNDS = 6
#: A prime below 2^31, so that products of two remainders fit a long.
PRIME = 2147483647


def constants(key: str) -> list[tuple[int, int]]:
    """Factor (never 0) and summand of each round's hash."""
    out = []
    for i in range(ROUNDS):
        digest = hashlib.sha256(f"{key}:{i}".encode()).hexdigest()
        out.append((int(digest[:8], 16) % (PRIME - 1) + 1, int(digest[8:16], 16) % PRIME))
    return out


class Permutation:
    def __init__(self, n: int, key: str):
        self.n, self.rounds = n, constants(key)
        self.a = isqrt(n - 1) + 1 if n > 1 else 1
        self.b = max(1, -(-n // self.a))

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = np.divmod(x, self.b)
        for i, (factor, summand) in enumerate(self.rounds):
            own = ((right if i % 2 == 0 else left) + summand) % PRIME
            own = own * own % PRIME * factor % PRIME
            if i % 2 == 0:
                left = (left + own) % self.a
            else:
                right = (right + own) % self.b
        return left * self.b + right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = np.divmod(x, self.b)
        for i, (factor, summand) in reversed(list(enumerate(self.rounds))):
            own = ((right if i % 2 == 0 else left) + summand) % PRIME
            own = own * own % PRIME * factor % PRIME
            if i % 2 == 0:
                left = (left - own) % self.a
            else:
                right = (right - own) % self.b
        return left * self.b + right

    def _walk(self, step, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.int64)
        if len(x) and (x.min() < 0 or x.max() >= self.n):
            raise IndexError(f"numbers must be in 0..{self.n - 1}")
        x = step(x)
        while (beyond := np.flatnonzero(x >= self.n)).size:
            x[beyond] = step(x[beyond])
        return x

    def at(self, x: np.ndarray) -> np.ndarray:
        """Where each of ``x`` goes."""
        return self._walk(self._once, x)

    def origin(self, x: np.ndarray) -> np.ndarray:
        """Where each of ``x`` comes from: the inverse of ``at``."""
        return self._walk(self._back, x)


class EpochOrder:
    """Numbers of the rows at the positions of an epoch.

    Runs of ``chunk`` consecutive numbers stay together and only their order
    changes, so that a step reads runs of a clustered table; 1 permutes single
    rows. Numbers that fill no chunk come last; which ones these are changes
    with the epoch, as numbers are turned by its own offset. Without a key
    positions are numbers."""

    def __init__(self, n: int, key: str | None, chunk: int = 1):
        if chunk < 1:
            raise ValueError(f"a chunk holds 1 row at least, got {chunk}")
        self.n, self.chunk, self.whole = n, chunk, n // chunk
        self.order = None if key is None else Permutation(self.whole, key)
        self.turn = 0 if key is None or chunk == 1 or not n else int(hashlib.sha256(f"{key}:turn".encode()).hexdigest()[:12], 16) % n

    def positions(self, numbers: np.ndarray) -> np.ndarray:
        """The inverse of ``numbers``: where each row stands in the epoch."""
        numbers = np.asarray(numbers, dtype=np.int64)
        if self.order is None:
            return numbers
        moved = (numbers - self.turn) % max(self.n, 1)
        at, rest = np.divmod(moved, self.chunk)
        own = at < self.whole
        moved[own] = self.order.origin(at[own]) * self.chunk + rest[own]
        return moved

    def numbers(self, positions: np.ndarray) -> np.ndarray:
        positions = np.asarray(positions, dtype=np.int64)
        if self.order is None:
            return positions
        at, rest = np.divmod(positions, self.chunk)
        moved = positions.copy()
        own = at < self.whole
        moved[own] = self.order.at(at[own]) * self.chunk + rest[own]
        return (moved + self.turn) % max(self.n, 1)
