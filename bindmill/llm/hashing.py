"""Hashes of many byte ranges of a text at once, and the ranges that words cover."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def scatter(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """64-bit hashes of byte ranges, the same wherever the bytes stand; powers are kept for the longest text so far."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if n > len(self.powers):
            size = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                    steps = np.full(size, base, dtype=np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps))
        sums = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n - 1], out=sums[1:])
        return sums

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return scatter((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))

    def runs(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all ranges of one length."""
        with np.errstate(over="ignore"):
            value = (sums[length:] - sums[:-length]) * self.inverses[:len(sums) - length]
            return scatter(value + np.uint64(length))


def word_ranges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text in bytes."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]
