"""Word hashes for numpy code that runs inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64


class _Known(dict):
    """word -> 64-bit hash; holds a bounded number of words and starts anew when full."""

    def __init__(self, most: int):
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class WordHashes:
    """Hashes of words as uint64 arrays. Frequent words come from a bounded table."""

    def __init__(self, most: int = 400_000):
        self._known = _Known(most)

    def __call__(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self._known.__getitem__, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order; empty if there are fewer words."""
    if len(hashes) < n:
        return hashes[:0]
    out = hashes[: len(hashes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = out * U64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    return mixed(out)
