"""Byte-pair encoding: merges of lowest rank first, from a heap over a doubly linked list of symbols."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

#: Bits that hold a symbol's place in a heap entry, below the rank.
PLACE = 32


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, others for the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Bpe:
    """A byte-level BPE model read from a tokenizers file; bounds on its caches keep a worker's memory flat."""

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        spec = model["model"]
        self.vocab: dict[str, int] = spec["vocab"]
        self.suffix: str = spec["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        letters = byte_letters()
        self.first = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.suffix) for c in letters]
        self.limit = limit

    def ids(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token. Bytes that the vocabulary doesn't have are left out, as the model has no unknown token."""
        symbols = [self.first[b] for b in piece[:-1]] + [self.last[b] for b in piece[-1:]]
        symbols = [s for s in symbols if s is not None]
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (m := merges.get((symbols[i], symbols[i + 1]))) is not None:
                heap.append(m[0] << PLACE | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        mask = (1 << PLACE) - 1
        while heap:
            entry = pop(heap)
            i = entry & mask
            if symbols[i] is None or (j := after[i]) >= n:
                continue
            m = merges.get((symbols[i], symbols[j]))
            if m is None or m[0] != entry >> PLACE:
                continue  # stale: one of the two has merged since
            symbols[i], symbols[j] = m[1], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := merges.get((symbols[i], symbols[k]))) is not None:
                    push(heap, m[0] << PLACE | i)
            if (h := before[i]) >= 0 and (m := merges.get((symbols[h], symbols[i]))) is not None:
                push(heap, m[0] << PLACE | h)
        return [s for s in symbols if s is not None]


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One model a worker and path."""
    return Bpe(path)
