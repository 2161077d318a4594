"""Word shingles as 64-bit hashes, and minwise signatures of them."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_K = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash of each word seen; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """A hash for each position's shingle; fewer words than `size` are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    known = _words
    ids = np.fromiter((known[w] for w in words), np.uint64, len(words))
    size = min(size, len(words))
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = total * _K + ids[k : len(words) - size + 1 + k]
    return scramble(total + np.uint64(size))


class MinHash:
    """`count` minwise hashes, 16 bits of each minimum."""

    def __init__(self, count: int):
        rng = np.random.default_rng(count)
        self.a = rng.integers(1 << 31, dtype=np.uint32, size=(count, 1)) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(1 << 32, dtype=np.uint32, size=(count, 1))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        low = None
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(h), 4096):
            part = (self.a * h[None, at : at + 4096] + self.b).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        return low

    @staticmethod
    def stored(minima: np.ndarray) -> np.ndarray:
        return ((minima * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of a signature."""
    parts = signature[: bands * rows].astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = scramble(key * _K + parts[:, k])
    return key.view(np.int64)
