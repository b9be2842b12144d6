"""Anchors: the places by which equal windows of bytes find each other, however they lie in their texts.

Every window of WINDOW bytes owns one anchor, the start of its q-gram of least hash (the leftmost of ties). It depends on the
window's bytes alone, so equal windows own anchors at the same offset with the same q-gram. Windows that share an anchor are
neighbours, so a text has few anchors: about 2 in WINDOW - GRAM.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

WINDOW, GRAM = 200, 60
#: Bytes that are worked on at once; windows of the next part begin where those of this one end.
PART = 1 << 21
_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_LETTERS = np.random.default_rng(17).integers(0, 2**64, 256, dtype=np.uint64)


class Anchors(NamedTuple):
    at: np.ndarray  #: places of anchors in the text
    gram: np.ndarray  #: 64-bit hashes of their q-grams
    first: np.ndarray  #: first window (start) that owns the anchor
    last: np.ndarray  #: last window that owns it


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _part(b: np.ndarray, window: int, gram: int) -> Anchors:
    n, wide = len(b), window - gram + 1
    powers, back = _powers(1 << max(12, int(n).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[b] * powers[:n], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1])
    key = (grams & ~_PLACE) | np.arange(n - gram + 1, dtype=np.uint64)
    least, span = key, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(key) - wide + 1], least[wide - span : len(key) - span + 1])
    owner = (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    at = owner[first]
    return Anchors(at, grams[at], first, np.append(first[1:], len(owner)) - 1)


def anchors(text: bytes, window: int = WINDOW, gram: int = GRAM) -> Iterator[Anchors]:
    """Anchors of a text, part by part; none for a text shorter than a window."""
    b = np.frombuffer(text, np.uint8)
    for start in range(0, max(0, len(b) - window + 1), PART):
        a = _part(b[start : start + PART + window - 1], window, gram)
        yield Anchors(a.at + start, a.gram, a.first + start, a.last + start)
