"""Many phrases looked for in one pass: the phrases of a list as one pattern with shared beginnings, so that a place of the text is left
at the first letter that no phrase goes on with, however many phrases there are."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern(phrases: list[str]) -> str:
    """Matches the longest phrase that starts at a place."""
    trie: dict = {}
    for p in phrases:
        node = trie
        for letter in p:
            node = node.setdefault(letter, {})
        node[""] = {}

    def of(node: dict) -> str:
        # a blank needs no escape in the patterns that Spark uses
        ways = [(" " if letter == " " else re.escape(letter)) + of(rest) for letter, rest in sorted(node.items()) if letter]
        if not ways:
            return ""
        if len(ways) == 1 and "" not in node:
            return ways[0]
        return f"(?:{'|'.join(ways)}){'?' if '' in node else ''}"

    return of(trie)


def holds_any(text: Column, phrases: list[str]) -> Column:
    return text.rlike(pattern([p for p in phrases if not any(q != p and q in p for q in phrases)]))


@lru_cache(maxsize=16)
def _best(phrases: tuple[str, ...]) -> dict[str, int]:
    """For each phrase the least place in the list of those that it starts with, itself included."""
    return {p: min(i for i, q in enumerate(phrases) if p.startswith(q)) for p in phrases}


def first_held(text: Column, phrases: list[str]) -> Column:
    """Place in the list of the first phrase, in the list's order, that the text holds; null if it holds none.

    At each place of the text the longest phrase that starts there is found; whatever else starts there is a beginning of it.
    """
    best = _best(tuple(phrases))
    longest = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({pattern(phrases)}))"), F.lit(1)))
    places = F.create_map(*(x for p, i in best.items() for x in (F.lit(p), F.lit(i))))
    return F.array_min(F.transform(longest, lambda w: places[w]))
