"""Permutations of 0..n-1 by arithmetic alone: no sort, no window, no table of positions.

A number below a * a, with a the root of n rounded up, is a pair of numbers below a. A round
swaps the two and adds a keyed hash of one to the other (a Feistel network), which can be undone,
so the rounds permute the a * a numbers. Those that land at n or above are sent round again until
they land below: at most 2 in a at a time. All products stay under 2 ** 63 for n up to 2 ** 62.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

PRIME = 2**31 - 1
ROUNDS = 6


def side(n: int) -> int:
    """The root of n, rounded up; 1 for n of 0."""
    return math.isqrt(n - 1) + 1 if n > 0 else 1


def keys(*parts: object) -> list[tuple[int, int, int]]:
    """Three numbers below the prime for each round, the middle one not 0."""
    out = []
    for i in range(ROUNDS):
        digest = hashlib.md5("-".join(map(str, (*parts, i))).encode()).digest()
        u, v, w = (int.from_bytes(digest[j : j + 4], "little") for j in (0, 4, 8))
        out.append((u % PRIME, 1 + v % (PRIME - 1), w % PRIME))
    return out


def _once(x: np.ndarray, a: int, by: list[tuple[int, int, int]]) -> np.ndarray:
    left, right = x // a, x % a
    for u, v, w in by:
        t = (right + u) % PRIME
        left, right = right, (left + (t * t % PRIME * v + w) % PRIME) % a
    return left * a + right


def permuted(x: np.ndarray, n: int, by: list[tuple[int, int, int]]) -> np.ndarray:
    """Where each of the numbers ``x`` below ``n`` goes."""
    a = side(n)
    out = _once(np.asarray(x, np.int64), a, by)
    late = np.flatnonzero(out >= n)
    while len(late):
        out[late] = _once(out[late], a, by)
        late = late[out[late] >= n]
    return out
