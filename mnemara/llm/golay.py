"""The binary (23, 12) Golay code as a fuzzy hash.

A 23-bit segment gets the indices (12-bit messages) of all codewords within distance 4: its nearest codeword
and, where that is 3 bits away, the five codewords at distance 4. Two segments that differ in at most two bits
always share an index. Tables come from the code's generator polynomial.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
KEYS = 6


def _remainder(v: int) -> int:
    for shift in range(11, -1, -1):
        if v >> (shift + 11) & 1:
            v ^= GENERATOR << shift
    return v


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits; coset leaders; index differences to codewords at distance 4 (-1: none)."""
    unit = [_remainder(1 << i) for i in range(23)]

    def syndromes(bits: int, first: int) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for i in range(bits):
            out = np.concatenate([out, out ^ unit[first + i]])
        return out

    low, high = syndromes(12, 0), syndromes(11, 12)
    messages = np.arange(4096, dtype=np.int64)
    words = (messages << 11) | syndromes(12, 11)[messages]
    sevens = words[np.bitwise_count(words) == 7]
    leader = np.zeros(2048, np.int64)
    far = np.full((2048, KEYS - 1), -1, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            pattern, s = sum(1 << i for i in places), 0
            for i in places:
                s ^= unit[i]
            leader[s] = pattern
            if weight == 3:
                far[s] = sevens[(sevens & pattern) == pattern] >> 11
    return low, high, leader, far


def indices(segment: np.ndarray) -> np.ndarray:
    """``(n, 6)`` codeword indices of ``n`` segments of up to 23 bits; -1 where there is none."""
    low, high, leader, far = tables()
    v = segment.astype(np.int64)
    s = low[v & 4095] ^ high[v >> 12]
    nearest = (v ^ leader[s]) >> 11
    more = far[s]
    return np.concatenate([nearest[:, None], np.where(more < 0, -1, more ^ nearest[:, None])], axis=1)
