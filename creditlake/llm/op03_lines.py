"""Line dedup: lines that many documents share stay in one document only.

Each document's lines become 128-bit keys where they lie; only keys are exchanged: range-partitioned by (key, document,
descending) and sorted, so that a task streams each key's documents, the keeper first. A key that is as frequent as a third of
all rows is spread over many tasks by its documents. The stream of a key that lies inside one task is decided there; the first
and the last key of a task may go on in a neighbour, so their rows wait for the key's total, taken over those rows alone (two
keys a task at most, which bounds what is broadcast). What comes back is a bitmap of lines to keep for each document
that loses any, compressed, and never text. Keys are dealt in order (``Ranges``), so the pass over texts runs once.

Defined cases: null or empty text is one empty line; a null doc_id ranks below all others; rows that repeat a doc_id count as one
document and each loses its own lines; lines of the keeper all stay; an empty table gives no rows; other columns pass through
``drop_lines`` and are ignored by ``line_digests``.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm.common import Ranges, ints, map_batches, only, packed, partitions, read, sampled, small_batches, staged, text_of, unpacked

MIN_CHARS, MIN_DOCS = 40, 5
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line: bytes, least: int) -> bytes | None:
    """The 16-byte key of a line whose stripped, A-Z-lowered form has at least so many code points."""
    key = line.strip(SPACE)
    if len(key) < least or (len(key) < 4 * least and sum(b & 0xC0 != 0x80 for b in key) < least):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _falling(column: pa.Array) -> np.ndarray:
    """Rises as doc_id falls, null last."""
    return ~ints(column)


def _keys(least: int, ranges: Ranges | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, places = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                found: dict[bytes, list[int]] = {}
                for n, line in enumerate(text.encode().split(b"\n")):
                    if len(line) >= least and (k := line_key(line, least)) is not None:
                        found.setdefault(k, []).append(n)
                keys += found
                rows += [i] * len(found)
                places += found.values()
            at = pa.array(rows, pa.int32())
            doc = b.column("doc_id").take(at)
            part = np.zeros(len(keys), np.int32) if ranges is None else ranges.part(np.array(keys, "S16"), _falling(doc))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), doc, b.column("digest").take(at), pa.array(places, pa.list_(pa.int32())), pa.array(part)], ["key", "doc_id", "digest", "places", "part"])

    return run


#: Kinds of rows that a task streams out: a decided drop, an undecided row, what the task knows of a key at its ends.
DROP, OPEN, EDGE = 0, 1, 2
_STREAM = pa.schema([("kind", pa.int8()), ("key", pa.binary()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("places", pa.list_(pa.int32())), ("docs", pa.int64())])


def _stream(least: int):
    """A task's rows, sorted by key and falling doc_id → DROP, OPEN and EDGE rows.

    A key that begins in this task has its keeper here, so its rows are decided once ``least`` documents have been seen; only the
    task's first key can have begun before it, and only its last can go on after it.
    """

    def decided(rows: Iterator[tuple]) -> Iterator[tuple]:
        edge = None
        for n, (key, group) in enumerate(itertools.groupby(rows, key=lambda r: r[0])):
            docs, waiting, keeper, last = 0, [], None, None
            for _, doc, digest, places in group:
                if docs == 0 or doc != last:
                    docs, last = docs + 1, doc
                    keeper = doc if docs == 1 else keeper
                if n == 0:
                    yield OPEN, key, doc, digest, places, 0
                elif docs == 1:
                    continue  # the keeper's own lines
                elif docs < least:
                    waiting.append((doc, digest, places))
                else:
                    for w in waiting:
                        yield DROP, key, *w, 0
                    waiting = []
                    yield DROP, key, doc, digest, places, 0
            if n == 0:
                yield EDGE, key, keeper, 0, [], docs
            edge = (n, key, keeper, docs, waiting)
        if edge and edge[0]:
            _, key, keeper, docs, waiting = edge
            yield EDGE, key, keeper, 0, [], docs
            for w in waiting:
                yield OPEN, key, *w, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "digest", "places")), strict=True))
        for part in itertools.batched(decided(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part, strict=True), _STREAM, strict=True)], schema=_STREAM)

    return run


def bitmap(places: list[int]) -> bytes:
    """A deflated bitmap of lines to keep, 0 at these places; lines behind its end are kept."""
    bits = np.ones(-(-(max(places) + 1) // 8) * 8, np.uint8)
    bits[places] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)


def dropped(bits: bytes | None) -> set[int]:
    return set() if bits is None else set(np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little") == 0).tolist())


def digest_of(text: Column) -> Column:
    """Tells rows apart that repeat a doc_id."""
    return F.xxhash64(text)


def line_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, digest, bits: for each document that loses lines, the deflated bitmap of those that it keeps."""
    small_batches(documents.sparkSession)
    text = text_of(documents)
    texts, row, n = only(documents, doc_id=documents["doc_id"].cast("long"), digest=digest_of(text), text=text), "key binary, doc_id long, digest long, places array<int>, part int", partitions(documents)
    known = map_batches(sampled(texts), _keys(min_chars, None), row).select("key", "doc_id").limit(200_000).toArrow()  # bounded; affects the balance only
    ranges = Ranges(np.array(known["key"].to_pylist(), "S16"), _falling(known["doc_id"].combine_chunks()), n)
    keys = map_batches(texts, _keys(min_chars, ranges), row).repartitionById(n, F.col("part")).drop("part")
    sorted_ = keys.sortWithinPartitions("key", F.col("doc_id").desc_nulls_last(), "digest")
    stream = staged(sorted_.mapInArrow(_stream(min_docs), "kind byte, key binary, doc_id long, digest long, places array<int>, docs long"), "lines")
    totals = stream.where(F.col("kind") == EDGE).groupBy("key").agg(F.sum("docs").alias("total"), F.max("doc_id").alias("keeper"))
    late = stream.where(F.col("kind") == OPEN).drop("docs").join(F.broadcast(totals), "key").where((F.col("total") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = stream.where(F.col("kind") == DROP).select("doc_id", "digest", "places").unionByName(late.select("doc_id", "digest", "places"))
    return drops.groupBy("doc_id", "digest").agg(F.udf(bitmap, "binary", useArrow=True)(F.flatten(F.collect_list("places"))).alias("bits"))


def _with_bitmaps(rows: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """rows (doc_id, digest and others) with the bitmap of their document, null ids included."""
    bits = bitmaps.withColumnsRenamed({"doc_id": "bits_doc", "digest": "bits_digest"}).hint("merge")
    return rows.join(bits, rows["doc_id"].eqNullSafe(bits["bits_doc"]) & (rows["digest"] == bits["bits_digest"]), "left").drop("bits_doc", "bits_digest")


def _kept(text: str, bits: bytes | None) -> tuple[int, int, str]:
    if bits is None:
        return text.count("\n") + 1, 0, text
    lines, gone = text.split("\n"), dropped(bits)
    return len(lines), len(gone), "\n".join([x for i, x in enumerate(lines) if i not in gone])


def drop_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """documents, all columns, with the kept lines as text; rows without a drop are as they were."""

    @F.pandas_udf("string")
    def kept(texts, bits):
        return texts.combine(bits, lambda t, b: None if t is None else _kept(unpacked(t).decode(), b)[2])

    bitmaps = line_bitmaps(documents, min_chars, min_docs)
    others = [c for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*(documents[c] for c in others)).alias("row"), documents["doc_id"].cast("long").alias("doc_id"), digest_of(text_of(documents)).alias("digest"), packed(documents["text"].cast("string")).alias("packed"))
    both = _with_bitmaps(rows, bitmaps).select("row", kept("packed", "bits").alias("text"))
    return both.select(*((F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in documents.columns))


def line_digests(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_kept(unpacked(t).decode(), bits) for t, bits in zip(b.column("packed").to_pylist(), b.column("bits").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([hashlib.sha256(m[2].encode()).hexdigest() for m in made], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    bitmaps, text = line_bitmaps(documents, min_chars, min_docs), text_of(documents)
    narrow = only(documents, doc_id=documents["doc_id"].cast("long"), digest=digest_of(text), packed=packed(text))
    return map_batches(_with_bitmaps(narrow, bitmaps).select("doc_id", "packed", "bits"), run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(read(spark, sf_dir, "documents"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (
  SELECT doc_id, line, n, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.line, k.n, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
