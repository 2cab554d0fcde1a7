"""Words of texts as 64-bit hashes, and the mixing of hashes, for vectorised work in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Lower-cased word -> hash, emptied past most words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self._most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """The hashes of text's words: runs of bytes that are not ASCII white space, A-Z lower-cased."""
        words = (text or b"").lower().split()
        if len(self) > self._most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that looks random (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the ordered pairs of a and b."""
    return scramble(a * _C1 + scramble(b + _C1))
