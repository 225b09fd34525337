"""Content hashes of all windows of a text, vectorised over code points.

A window's hash is a difference of prefix sums of mixed code points times powers
of an odd base modulo 2^64, moved to offset 0 by the inverse power and mixed
again: equal content gives equal hashes wherever it stands.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _MIX[0]
    x ^= x >> _U(27)
    x *= _MIX[1]
    x ^= x >> _U(31)
    return x


@lru_cache(maxsize=8)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Prefix:
    """Prefix sums of an array of code points."""

    def __init__(self, points: np.ndarray, which: int = 0):
        n = 1 << max(12, int(len(points) + 1).bit_length())
        self.power, self.inverse = _powers(n, which)
        values = mixed(points.astype(np.uint64) + _U(0x5851F42D4C957F2D + which))
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(values * self.power[: len(points)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the contents [start, end); the length is mixed in."""
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mixed(raw + (end - start).astype(np.uint64) * _MIX[0])

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all windows of k code points."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[k:] - self.sums[:-k]) * self.inverse[:n] + _U(k * int(_MIX[0]) % (1 << 64)))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
