"""Anchors whose gram occurs again, and those whose gram is frequent, from tasks that hold anchors in order of gram.

A task decides the grams that lie inside it. Only its first and its last gram can go on in other tasks; it says how many rows of those it
has, and totals of these, two a task at most, decide their rows. So no list of frequent grams is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import staged

#: gram: of rows that wait for its total; rows: what a task knows of a gram at its ends; place: -1 - place where the gram is frequent.
_MARKS = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("place", pa.int32()), ("rows", pa.int64())])


def _marks(hot: int):
    """A task's anchors, sorted by gram → those whose gram occurs again, decided where it lies inside the task."""

    def made(b: pa.RecordBatch, often: np.ndarray | bool, waits: bool) -> pa.RecordBatch:
        place = b.column("place").to_numpy()
        gram = b.column("gram") if waits else pa.nulls(b.num_rows, pa.int64())
        return pa.RecordBatch.from_arrays([gram, b.column("doc_id"), b.column("digest"), pa.array(np.where(often, -1 - place, place).astype(np.int32)), pa.nulls(b.num_rows, pa.int64())], schema=_MARKS)

    def edge(gram: int, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"gram": gram, "rows": n}], schema=_MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n, first, held = None, 0, True, []  # the gram that is open, its rows so far, whether it is the task's first, rows held back
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("gram").to_numpy()
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(g))
            counts = (ends - starts)[1:-1]
            if len(counts) and counts.max() > 1:
                size = np.repeat(counts, counts)
                inner = b.slice(int(ends[0]), int(starts[-1] - ends[0])).filter(pa.array(size > 1))
                yield made(inner, size[size > 1] >= hot, False)
            for k in (0, -1) if len(starts) > 1 else (0,):
                rows, name = b.slice(int(starts[k]), int(ends[k] - starts[k])), int(g[starts[k]])
                if gram != name:
                    if gram is not None and first:
                        yield edge(gram, n)
                    elif 1 < n < hot:
                        yield from (made(h, False, False) for h in held)
                    gram, n, first, held = name, 0, gram is None, []
                n += rows.num_rows
                if first:
                    yield made(rows, False, True)
                elif n < hot:
                    held.append(rows)
                else:
                    yield from (made(h, True, False) for h in [*held, rows])
                    held = []
        if gram is not None:
            yield edge(gram, n)
            yield from (made(h, False, True) for h in held)

    return run


def repeated_places(sorted_: DataFrame, hot: int) -> DataFrame:
    """gram, doc_id, digest, place (int), sorted by gram in each task → doc_id, digest, places: those whose gram occurs again; -1 - place if in ``hot`` rows or more."""
    marks = staged(sorted_.mapInArrow(_marks(hot), "gram long, doc_id long, digest long, place int, rows long"), "anchors")
    totals = marks.where("rows is not null").groupBy("gram").agg(F.sum("rows").alias("total"))  # two a task at most
    known = marks.where("rows is null").join(F.broadcast(totals), "gram", "left").where("gram is null or total > 1")
    place = F.when(F.col("total") >= hot, -1 - F.col("place")).otherwise(F.col("place"))
    return known.select("doc_id", "digest", place.alias("place")).groupBy("doc_id", "digest").agg(F.sort_array(F.collect_list("place")).alias("places"))
