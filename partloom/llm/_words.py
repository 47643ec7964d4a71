"""Hashes of words and word n-grams of whole texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Polynomial multipliers of rolling hashes.
MUL = np.uint64(0x9E3779B97F4A7C15)
MUL2 = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """64-bit hash of each word, remembered for up to ``LIMIT`` words."""

    LIMIT = 250_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def rolling(h: np.ndarray, n: int, mul: np.uint64 = MUL) -> np.ndarray:
    """Hashes of all runs of ``n`` words (fewer words: none)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out *= mul
        out += h[j : j + m]
    return mixed(out)
