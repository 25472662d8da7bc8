"""Vectorised substring hashes, used inside tasks.

A prefix polynomial modulo 2**64 with an odd base gives the hash of any slice in constant time; a finaliser spreads
it over all bits. Arrays are of one document's length, so memory is about 40 bytes a byte of the longest document.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse; grown by doubling and kept by the worker."""
    for i, base in enumerate((_BASE, _INVERSE)):
        while len(_tables[i]) < n:
            old = _tables[i]
            _tables[i] = np.concatenate([old, old * np.uint64(pow(base, len(old), 1 << 64))])
    return _tables[0], _tables[1]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slices:
    """Hashes of slices of one sequence of unsigned values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power, self.inverse = _powers(n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start], seed)

    def windows(self, width: int, seed: int = 0) -> np.ndarray:
        """Of every slice of this width, by its start."""
        n = len(self.prefix) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[width:] - self.prefix[:n]) * self.inverse[:n], seed)


_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the runs of bytes other than ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_space[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a UTF-8 text, with their starts and ends in bytes."""
    data = np.frombuffer(raw, np.uint8)
    start, end = word_bounds(data)
    return Slices(data).hash(start, end), start, end
