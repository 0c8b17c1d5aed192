"""Hashed word shingles of whole texts, shared by the operators that compare documents."""

from __future__ import annotations

import numpy as np
import xxhash

from . import caches

SIZE = 5
#: Fixed odd multipliers, from the golden ratio's bits by a rule: one for each place in a shingle and one for the length.
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1 for i in range(1, SIZE + 2)], np.uint64)
HELD = 200_000


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met last."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = WordHashes()
caches.register("words", _hashes.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words by ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, size: int = SIZE) -> np.ndarray:
    """One hash for each run of `size` words; fewer words make one run; none make none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(size, n)
    total = np.full(n - size + 1, np.uint64(size) * PLACES[SIZE], np.uint64)
    for i in range(size):
        total += mixed(hashes[i : n - size + 1 + i] + PLACES[i % SIZE]) * PLACES[i % SIZE]
    return mixed(total)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(runs(word_hashes(words_of(text)), size))
