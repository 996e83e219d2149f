"""Vectorised hashing of the words and byte n-grams of texts."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all their bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def blocks(raw: bytes, block: int = BLOCK):
    """Pieces of about ``block`` bytes, cut at white space so that no word is split."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + block)
        while end < len(raw) and raw[end] not in b"\t\n\x0b\x0c\r ":
            end += 1
        yield raw[at:end]
        at = end


def spaces(codes: np.ndarray) -> np.ndarray:
    return _SPACE[codes]


def word_hashes(codes: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of one array of bytes, and where each starts."""
    solid = ~_SPACE[codes]
    edge = np.diff(solid.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    where = np.flatnonzero(solid)
    first = np.searchsorted(where, starts)
    lengths = np.diff(first, append=len(where))
    depth = np.arange(len(where)) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), BASE, np.uint64))
    values = (_FOLD[codes[where]] if fold else codes[where]).astype(np.uint64) + np.uint64(1)
    return mix(np.add.reduceat(values * powers[depth], first) + lengths.astype(np.uint64)), starts


def words_of(text: str, fold: bool = False) -> np.ndarray:
    """Word hashes of a whole text, in order."""
    parts = [word_hashes(np.frombuffer(b, np.uint8), fold)[0] for b in blocks(text.encode("utf-8", "surrogatepass"))]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words; of the whole sequence if it is shorter."""
    n = min(n, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        h = (h + words[i : len(words) - n + 1 + i]) * BASE
        h ^= h >> np.uint64(29)
    return np.unique(mix(h + np.uint64(n)))
