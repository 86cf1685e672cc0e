"""Word shingles as 64-bit hashes, for the near-duplicate operators.

Texts are lower-cased in A-Z alone and split at ASCII white space; a set holds
the distinct shingles of `words` words, or the whole sequence as one where a
text has fewer; no words give an empty set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.words import split

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def word_hashes(column: pa.Array, lower: bool = True) -> list[np.ndarray]:
    """A 64-bit hash of each word of each text of a column."""
    import xxhash

    numbers, ends, words = split(column, _LOWER if lower else None)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[numbers]
    return [hashes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles_of(w: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all shingles of a text's word hashes, repeats included."""
    if not len(w):
        return w
    size = min(words, len(w))
    n = len(w) - size + 1
    total, factor = np.full(n, size if size < words else 0, np.uint64), 1
    for k in range(size):
        factor = factor * _ODD + 2 * k & _MASK | 1
        total += w[k : k + n] * np.uint64(factor)
    return mix(total)


def shingle_sets(column: pa.Array, words: int, lower: bool = True) -> list[np.ndarray]:
    """The distinct shingles of each text of a column, ascending."""
    return [np.unique(shingles_of(w, words)) for w in word_hashes(column, lower)]


class MinMax:
    """Smallest and largest value under each of `count` permutations of the
    64-bit numbers: twice as many signature values as hash evaluations."""

    def __init__(self, count: int, seed: int = 20240607):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, count, np.uint64)

    def values(self, shingles: np.ndarray, chunk: int = 2048) -> np.ndarray:
        low = np.full(len(self.a), _MASK, np.uint64)
        high = np.zeros(len(self.a), np.uint64)
        for at in range(0, len(shingles), chunk):
            y = self.a[:, None] * shingles[None, at : at + chunk] + self.b[:, None]
            np.minimum(low, y.min(1), out=low)
            np.maximum(high, y.max(1), out=high)
        return np.concatenate([low, high])
