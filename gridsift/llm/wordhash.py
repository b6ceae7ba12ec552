"""64-bit hashes of words and of runs of words, the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash

#: So many distinct words keep their hash, in a worker's memory.
MEMO_WORDS = 200_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got


class WordHashes:
    def __init__(self):
        self.memo = _Memo()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on each bit of x."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of so many words, in order. Fewer words than that: one hash of them all; none: nothing."""
    if not len(hashes):
        return hashes
    size_here = min(size, len(hashes))
    n = len(hashes) - size_here + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(size_here) * _STEP, np.uint64)
        for k in range(size_here):
            out = mixed(out + _STEP) + hashes[k : k + n]
        return mixed(out)
