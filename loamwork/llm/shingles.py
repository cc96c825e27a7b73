"""Word shingle sets as sorted 64-bit hashes.

Words are the maximal runs without ASCII white space, A-Z lower-cased; a set holds the distinct
three-word shingles, or the whole sequence as one shingle when there are one or two words.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_F1, _F2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> _S)) * _F1
    x = (x ^ (x >> _S)) * _F2
    return x ^ (x >> _S)


class WordHashes(dict):
    """Word to 64-bit hash, remembered; emptied at ``limit`` words so that memory stays bounded."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, width: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty for a null text or one without words."""
    if not text:
        return np.empty(0, np.uint64)
    split = text.encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    n = min(width, len(split))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        acc = mix(acc * _M2 + h[k : len(h) - n + 1 + k] * _M1 + _M3)
    acc.sort()
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]
