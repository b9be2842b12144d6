"""Elements of very large JSON arrays: a file is cut into byte ranges, and each range is read by a task of its own.

From the middle of a file nobody can tell whether a byte stands inside a string. So ranges are scanned first, each under the three
states in which it can begin (outside a string, inside, inside behind a backslash), which gives the state and the change of depth at
its end; then the ranges of a file, a few numbers each, are put together in order, so that each knows how it begins. Only then are
elements read: a range gives those whose comma (or opening bracket) lies in it, and reads on behind its end to finish the last one.
Strings with brackets, quotes, backslashes and commas are right for every cut. A file is read twice, by many tasks; none holds more
than a range and one element. Files are opened with ``pyarrow.fs``, so a path can be any that it knows.

Defined cases: an array is bare or under ``keys``, the first that has one at the top of the object; files that hold neither, empty
files and empty arrays give no rows. What is behind the array's end isn't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, and of what is read at once behind its end.
RANGE, MORE = 16 << 20, 1 << 18
_QUOTE, _ESCAPE, _COMMA = 34, 92, 44


class State(NamedTuple):
    """How a range begins."""

    inside: bool = False  #: inside a string
    escaped: bool = False  #: behind a backslash
    depth: int = 0


class Scan:
    """Bytes of a range, given how it begins: depth behind each byte, which bytes are outside strings, and how the range ends."""

    def __init__(self, data: bytes, state: State):
        b = self.bytes = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], b == _ESCAPE, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        odd = (ends - starts - (state.escaped & (starts == 0))) % 2 == 1
        quote = b == _QUOTE
        escaped = ends[odd]
        quote[escaped[escaped < len(b)]] = False
        if state.escaped and len(b):
            quote[0] = False
        after = (np.cumsum(quote, dtype=np.uint8) & 1).astype(bool) ^ state.inside
        self.outside = ~(after | quote)
        change = np.zeros(len(b), np.int8)
        change[(b == 91) | (b == 123)] = 1
        change[(b == 93) | (b == 125)] = -1
        change[~self.outside] = 0
        self.depth = np.cumsum(change, dtype=np.int32) + state.depth
        self.end = State(bool(after[-1]), bool(len(odd) and odd[-1] and ends[-1] == len(b)), int(self.depth[-1])) if len(b) else state

    def borders(self, depth: int) -> np.ndarray:
        """Places of commas between elements at this depth, and of the bracket that ends them."""
        return np.flatnonzero(self.outside & (((self.bytes == _COMMA) & (self.depth == depth)) | ((self.bytes == 93) & (self.depth == depth - 1))))


def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path)


#: The three ways in which a range can begin, as far as strings go.
BEGINNINGS = (State(), State(True), State(True, True))
#: inside, escaped, change: how the range ends for each beginning; low: its least depth; opens: arrays that may be the wanted one.
_SCANNED = "path string, start long, size long, inside array<boolean>, escaped array<boolean>, change array<int>, low array<int>, opens array<struct<beginning:int,key:int,at:long,depth:int,closed:boolean>>"
#: Bytes before a range in which the key of a bracket that stands in it may lie.
_KEY = 1024


def _opens(before: bytes, data: bytes, start: int, keys: list[str], names: re.Pattern | None) -> list[dict]:
    """For each beginning the first array of each key (-1: the one that begins the file) at the least depth, where one at the top would be."""
    whole = before + data
    found = [(-1, m.end() - 1)] if start == len(before) and (m := re.match(rb"\s*\[", whole)) else []
    found += [(keys.index(m[1].decode()), m.end() - 1) for m in names.finditer(whole)] if names else []
    found = [(key, at - len(before)) for key, at in found if at >= len(before)]
    out = []
    for k, beginning in enumerate(BEGINNINGS if found else ()):
        scan = Scan(data, beginning)
        at_top = [(key, at) for key, at in found if scan.outside[at]]
        least = min((scan.depth[at] for _, at in at_top), default=0)
        for key, at in {key: at for key, at in reversed(at_top) if scan.depth[at] == least}.items():
            out.append({"beginning": k, "key": key, "at": start + at, "depth": int(scan.depth[at]) - 1, "closed": bool((scan.depth[at:] < scan.depth[at]).any())})
    return out


def _scanned(keys: list[str]):
    names = re.compile(rb'(?<!\\)"(' + b"|".join(re.escape(k.encode()) for k in keys) + rb')"\s*:\s*\[') if keys else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, start, size in zip(b["path"], b["start"], b["size"], strict=True):
                with _open(path) as f:
                    f.seek(max(0, start - _KEY))
                    before, data = f.read(min(start, _KEY)), f.read(size)
                scans = [Scan(data, s) for s in BEGINNINGS]
                ends = [s.end for s in scans]
                rows.append((path, start, size, [e.inside for e in ends], [e.escaped for e in ends], [e.depth for e in ends], [int(s.depth.min(initial=0)) for s in scans], _opens(before, data, start, keys, names)))
            yield pd.DataFrame(rows, columns=["path", "start", "size", "inside", "escaped", "change", "low", "opens"])

    return run


_BEGUN = "path string, start long, size long, inside boolean, escaped boolean, depth int, at long, wanted int"


def _begun(ranges: pd.DataFrame) -> pd.DataFrame:
    """A file's ranges → those that hold the wanted array, how each begins, where the array opens (-1: before), and its depth."""
    state, begun, opened = State(), [], []
    for r in ranges.sort_values("start").itertuples(index=False):
        k = BEGINNINGS.index(state._replace(depth=0))
        begun.append((r.path, r.start, r.size, *state, state.depth + r.low[k]))
        opened += [(o["key"], o["at"], o["closed"], len(begun) - 1) for o in r.opens if o["beginning"] == k and o["depth"] + state.depth == (o["key"] >= 0)]
        state = State(bool(r.inside[k]), bool(r.escaped[k]), int(r.change[k]) + state.depth)
    out = []
    if opened:
        key, at, closed, first = min(opened, key=lambda o: o[:2])
        wanted = 1 + (key >= 0)
        for n, (*b, low) in enumerate(begun[first:]):
            out.append((*b, -1 if n else at, wanted))
            if closed if n == 0 else low < wanted:
                break
    return pd.DataFrame(out, columns=[c.split()[0] for c in _BEGUN.split(", ")])


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ranges that know how they begin → elements that begin in them."""
    for b in batches:
        for r in b.itertuples(index=False):
            rows: list[tuple] = []
            with _open(r.path) as f:
                f.seek(r.start)
                data = f.read(r.size)
                scan = Scan(data, State(r.inside, r.escaped, r.depth))
                begins = [] if r.at < 0 else [r.at - r.start]
                borders = scan.borders(r.wanted)
                borders = borders[borders > (begins[0] if begins else -1)]
                closed = np.flatnonzero(scan.bytes[borders] == 93)
                ended = bool(len(closed))
                places = begins + borders[: closed[0] + 1 if ended else None].tolist()
                tail, state = [], scan.end
                while not ended and places:  # the last element ends behind the range
                    more = f.read(MORE)
                    scan = Scan(more, state)
                    hit, state = scan.borders(r.wanted), scan.end
                    ended = bool(len(hit)) or not more
                    tail.append(more[: hit[0]] if len(hit) else more)
                    if ended:
                        data, places = data + b"".join(tail), [*places, len(data) + sum(map(len, tail))]
            for a, z in zip(places, places[1:], strict=False):
                if value := data[a + 1 : z].strip():
                    rows.append((r.path, r.start + a, value.decode()))
                if len(rows) == 10_000:
                    yield pd.DataFrame(rows, columns=["path", "at", "value"])
                    rows = []
            yield pd.DataFrame(rows, columns=["path", "at", "value"])


def read_elements(spark: SparkSession, path: str, keys: list[str] | None = None, size: int = RANGE) -> DataFrame:
    """path, at (the place of an element in its file, so elements of a file are in its order), value (its text), of JSON arrays in files."""
    keys = keys or []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long")))
    ranges = files.select("path", "length", at.alias("start")).select("path", "start", F.least(F.lit(size).cast("long"), F.col("length") - F.col("start")).alias("size"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = ranges.repartition(n, "path", "start").mapInPandas(_scanned(keys), _SCANNED)
    begun = scanned.groupBy("path").applyInPandas(_begun, _BEGUN)  # a row a range
    return begun.repartition(n, "path", "start").mapInPandas(_elements, "path string, at long, value string")
