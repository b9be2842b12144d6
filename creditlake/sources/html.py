"""Tables and criteria texts of web pages, read in Arrow batches by the standard library's parser.

Pages are read as browsers do: end tags of nothing open are ignored, end tags that were left out are implied by what starts next (a
paragraph ends at the next block, an item at the next item, a cell at the next cell), and inline end tags don't close parts of a table.

The work is linear in the page: texts are joined once and elements are ranges of them; the depths at which each tag is open are kept
by tag, so what an end tag closes is looked up and the open elements are never searched. Tables within tables are the exception, as a
cell counts for every table around it. Null or empty pages have no tables and an empty criteria text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_TABLE = {"table", "thead", "tbody", "tfoot", "tr", "td", "th"}
_CELLS = {"td", "th"}
_GROUPS = {"thead", "tbody", "tfoot"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}
#: What the start of an element ends: (open elements, those that must not stand between).
_IMPLIED = {
    **dict.fromkeys(_BLOCKS, ({"p"}, {"table", "td", "th", "caption", "button"})),
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th", "table"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl", "td", "th", "table"})),
    **dict.fromkeys(("option", "optgroup"), ({"option"}, {"select", "td", "th", "table"})),
    **dict.fromkeys(_CELLS, (_CELLS, {"table", "tr"})),
    "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(_GROUPS, (_GROUPS | {"tr"}, {"table"})),
}
#: Fixed: elements that can hold a heading, elements that can name criteria, and the heading itself.
_HEADINGS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "b", "strong", "u"}
_CRITERIA = {"a", "td", "th", "li", "p"}
HEADING = r"key\s*financial\s*indicator"


class _Page(HTMLParser):
    """Elements as ranges of text pieces, and tables as rows of cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.parents: list[int] = []  # of each piece, the element that it stands in
        self.elements: list[list] = []  # [tag, first piece, piece behind the last]
        self.open: list[int] = []
        self.depths: defaultdict[str, list[int]] = defaultdict(list)  # of each tag, where it stands in open
        self.tables: list[tuple[int, list[list[int]]]] = []  # (element, rows of cell elements)
        self.parts: dict[int, list] = {}  # rows of each table, cells of each row

    def feed_whole(self, html: str | None) -> _Page:
        self.feed(html or "")
        self.close()
        while self.open:
            self._pop()
        raw, spaced = [], []
        self.at_raw, self.at_spaced, n, m = [0], [0], 0, 0
        for p in self.pieces:
            raw.append(p)
            n += len(p)
            if s := " ".join(p.split()):
                spaced.append(s)
                m += len(s) + 1
            self.at_raw.append(n)
            self.at_spaced.append(m)
        self.raw, self.spaced = "".join(raw), " ".join(spaced)
        return self

    def _pop(self) -> None:
        element = self.elements[self.open.pop()]
        element[2] = len(self.pieces)
        self.depths[element[0]].pop()

    def _innermost(self, tags: set[str]) -> int:
        """Where in open the innermost element of these tags stands, or -1."""
        return max((self.depths[t][-1] for t in tags if self.depths[t]), default=-1)

    def _close(self, tags: set[str], within: set[str]) -> None:
        """Ends the innermost open element of these, if none of ``within`` stands between."""
        depth = self._innermost(tags)
        if depth > self._innermost(within - tags):
            while len(self.open) > depth:
                self._pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _IMPLIED:
            self._close(*_IMPLIED[tag])
        if tag in _VOID:
            return
        k = len(self.elements)
        self.elements.append([tag, len(self.pieces), 0])
        if tag == "table":
            self.tables.append((k, self.parts.setdefault(k, [])))
        elif tag == "tr" or tag in _CELLS:  # a nested row belongs to all tables around it, a nested cell to all rows
            made = self.parts.setdefault(k, []) if tag == "tr" else k
            for depth in self.depths["table" if tag == "tr" else "tr"]:
                self.parts[self.open[depth]].append(made)
        self.depths[tag].append(len(self.open))
        self.open.append(k)

    def handle_endtag(self, tag: str) -> None:
        self._close({tag}, {"table"} - {tag} if tag in _TABLE else _TABLE)

    def handle_data(self, data: str) -> None:
        if not (self.open and self.elements[self.open[-1]][0] in ("script", "style")):
            self.pieces.append(data)
            self.parents.append(self.open[-1] if self.open else -1)

    def said(self, element: int) -> str:
        """Text of an element, its pieces parted by blanks."""
        _, a, b = self.elements[element]
        return self.spaced[self.at_spaced[a] : self.at_spaced[b]].strip()

    def tables_behind(self, heading: str) -> list[list[list[str]]]:
        """The next table after the start of each element with such a heading, once each: first those whose heading is in one piece, then those where it is split."""
        hits = [m.span() for m in re.finditer(heading, self.raw, re.I)]
        starts, found = [h[0] for h in hits], []
        for a, b in hits:
            piece = bisect_right(self.at_raw, a) - 1
            if self.parents[piece] >= 0 and b <= self.at_raw[piece + 1]:
                found.append(self.parents[piece])
        for k, (tag, first, last) in enumerate(self.elements):
            if tag in _HEADINGS:
                i = bisect_left(starts, self.at_raw[first])
                if i < len(hits) and hits[i][1] <= self.at_raw[last]:
                    found.append(k)
        at = [t for t, _ in self.tables]
        chosen = dict.fromkeys(i for k in found if (i := bisect_right(at, k)) < len(at))
        return [[[self.said(c) for c in row] for row in self.tables[i][1]] for i in chosen]

    def naming(self, words: str) -> str:
        """Lower-cased texts of the elements that can name criteria and hold these words; one within another is part of it already."""
        low = self.spaced.lower()
        starts = [m.start() for m in re.finditer(re.escape(words), low)]
        out, behind = [], -1
        for tag, first, last in self.elements:
            if tag in _CRITERIA and last > behind:
                a, b = self.at_spaced[first], self.at_spaced[last]
                i = bisect_left(starts, a)
                if i < len(starts) and starts[i] + len(words) <= b:
                    out.append(low[a:b].strip())
                    behind = last
        return " ".join(out)


def html_cells(pages: DataFrame, heading: str = HEADING) -> DataFrame:
    """doc_id, table_no, row_no, cells of tables that stand behind a heading. pages: doc_id, html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, t, r, c) for d, h in zip(b.doc_id, b.html, strict=True) for t, table in enumerate(_Page().feed_whole(h).tables_behind(heading)) for r, c in enumerate(table)]
            yield pd.DataFrame(rows, columns=["doc_id", "table_no", "row_no", "cells"])

    return pages.select("doc_id", "html").mapInPandas(run, "doc_id long, table_no int, row_no int, cells array<string>")


def criteria_text(pages: DataFrame) -> DataFrame:
    """doc_id, criteria: lower-cased texts of links, cells, items and paragraphs that say 'criteria for'."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "criteria": [_Page().feed_whole(h).naming("criteria for") for h in b.html]})

    return pages.select("doc_id", "html").mapInPandas(run, "doc_id long, criteria string")
