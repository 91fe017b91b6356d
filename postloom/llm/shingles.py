"""Five-word shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import sys
from hashlib import blake2b

import numpy as np
from pyspark import cloudpickle

WORDS_KEPT = 1 << 18
_STEP = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word -> hash, remembered. Forgets all when full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


def shingle_set(text: bytes | None, known: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles.

    Words lie between the bytes 0x20 and 0x09-0x0D; A-Z count as a-z. A text of
    fewer than ``width`` words has one shingle, all its words; one without words
    has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) < width:
        out = np.array([len(words)], dtype=np.uint64)
        for i in range(len(h)):
            out = mix(out + h[i : i + 1]) * _STEP[0]
        return out
    n = len(h) - width + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total = (total ^ h[i : i + n]) * _STEP[i % len(_STEP)]
        total ^= total >> np.uint64(29)
    return np.unique(mix(total))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
