"""Words, shingles and their hashes.

A word is a run of characters other than space and the controls 9 to 13; only A-Z are lower-cased. ``bytes.split``
and ``bytes.lower`` do exactly this on UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)


def words(text: bytes) -> list[bytes]:
    return text.lower().split()


class WordHashes(dict):
    """64-bit hashes of words. It forgets all when it holds ``most`` words, so a task's memory is bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters neighbouring values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words make one shingle of all; none, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    w = min(width, n)
    with np.errstate(over="ignore"):
        out = np.full(n - w + 1, np.uint64(w) * MIX, np.uint64)
        for i in range(w):
            out = mix(out * STEP + hashes[i : n - w + 1 + i] + MIX)
    return np.unique(out)
