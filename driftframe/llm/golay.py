"""The perfect binary Golay code of 23 bits: every word lies within distance 3 of exactly one of 4,096 codewords."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: Fixed value: a generator polynomial of the code (degree 11).
GENERATOR = 0b101011100011
BITS = 23


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each bit, and the error pattern of weight at most 3 of each of the 2,048 syndromes."""
    bit = np.array([_remainder(1 << i) for i in range(BITS)], np.int64)
    errors = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(BITS), weight):
            s = e = 0
            for p in places:
                s, e = s ^ int(bit[p]), e | 1 << p
            errors[s] = e
    return bit, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    bit, errors = _tables()
    words = np.asarray(words, np.int64)
    syndrome = np.zeros_like(words)
    for i in range(BITS):
        syndrome ^= (words >> i & 1) * bit[i]
    return (words ^ errors[syndrome]) >> 11


def near_indices(words: np.ndarray) -> np.ndarray:
    """A row of 6 codeword indices for each word: those that the word or a word one bit away decodes to (padded with the first).

    If a and b differ in one bit, decode(b) is among near_indices(a); a word within 2 of its codeword has that index only, one
    at distance 3 has five more.
    """
    words = np.asarray(words, np.int64)
    own = decode(words)
    around = np.column_stack([own, *(decode(words ^ (1 << i)) for i in range(BITS))])
    around.sort(axis=1)
    first = np.ones(around.shape, bool)
    first[:, 1:] = around[:, 1:] != around[:, :-1]
    rank = np.cumsum(first, axis=1) - 1
    out = np.repeat(own[:, None], 6, axis=1)
    rows, cols = np.nonzero(first)
    out[rows, rank[rows, cols]] = around[rows, cols]
    return out
