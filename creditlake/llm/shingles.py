"""Word shingles of whole texts as sorted 64-bit hashes, and the segments by which similar sets find each other."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0xD1342543DE82EF95 | 1
_LETTERS = np.random.default_rng(23).integers(0, 2**64, 256, dtype=np.uint64)
_PLACES = np.random.default_rng(29).integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, in order; words are runs without [\\x20\\x09-\\x0D], A-Z lower-cased."""
    b = np.frombuffer(text.encode(), np.uint8)
    space = _SPACE[b]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edges[::2], edges[1::2]
    powers, back = _powers(1 << max(12, len(b).bit_length()))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_LETTERS[_LOWER[b]] * powers[: len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of runs of ``words`` words, sorted; the whole sequence if it is shorter; none for no words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(words, len(w))
    n = len(w) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s += w[i : i + n] * _PLACES[i]
    return np.unique(mix(s))
