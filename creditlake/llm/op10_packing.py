"""Packing: documents laid along a Hilbert curve and cut into full sequences.

Each text gets a hashed vector of its byte trigrams, projected to DIMENSIONS and quantised to a key on a Hilbert curve. Documents
are range-partitioned and sorted by that key, so neighbours in a sequence are neighbours on the curve; each task then encodes its
documents, one after the other, and cuts the stream of ids every LENGTH ids. Token ids are never exchanged. What is left at a
task's end is cut into sequences whose lengths are powers of two, so that no sequence is padded.

A key that a third of all documents share is spread over tasks by doc_id. Defined cases: null text is the empty text (its end mark
alone); ties on the curve go by doc_id, then by the text's hash; rows that repeat are packed each; a null doc_id sorts first and is
returned as null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm.common import Ranges, ints, map_batches, only, partitions, read, sampled, small_batches, text_of, unpacked
from creditlake.llm.op02_bpe import SPACE, tokenizer_path

LENGTH, END_ID = 2048, 1
DIMENSIONS, BITS, BUCKETS = 4, 12, 512
_CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def projection() -> np.ndarray:
    return np.random.default_rng(11).normal(size=(BUCKETS, DIMENSIONS))


def vector(text: str) -> np.ndarray:
    """Unit vector of hashed byte trigrams."""
    b = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(23) if len(b) > 2 else b
    v = np.bincount(h, minlength=BUCKETS).astype(float)
    return v / max(np.linalg.norm(v), 1e-12)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer cells in [0, 2**bits), after Skilling's transform of axes."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit & 1)
    return key


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, run by run; the merges are those of the tokenizers file."""

    def __init__(self, ranks_path: str, limit: int = 400_000):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {"<|endoftext|>": len(ranks)}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = limit

    def run(self, chunk: str) -> bytes:
        made = self.older.get(chunk)
        if made is None:
            made = np.array(self.encoding.encode_ordinary(chunk), "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self.known) >= self.limit:
                self.older, self.known = self.known, {}
            self.known[chunk] = made
        return made

    def plain(self, text: str) -> bytes:
        get, run = self.known.get, self.run
        return b"".join([get(c) or run(c) for c in _CHUNKS.findall(text)])

    def ids(self, text: str) -> bytes:
        (mark, number), *_ = self.special.items()
        if mark not in text:
            return self.plain(text)
        return number.to_bytes(4, "little").join(map(self.plain, text.split(mark)))


@lru_cache(maxsize=2)
def encoder(ranks_path: str) -> Encoder:
    return Encoder(ranks_path)


class Packer:
    """Cuts a stream of documents into sequences. Pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)."""

    def __init__(self, first: int, length: int = LENGTH):
        self.sequence, self.length, self.open, self.fill = first, length, [], 0

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        total = start = 0
        total = len(ids) // 4
        while start < total:
            n = min(self.length - self.fill, total - start)
            part = ids[4 * start : 4 * (start + n)]
            self.open.append((doc, start, n, zlib.crc32(part), total, self.sequence, self.fill, part))
            start, self.fill = start + n, self.fill + n
            if self.fill == self.length:
                yield from self.open
                self.open, self.fill, self.sequence = [], 0, self.sequence + 1

    def close(self) -> Iterator[tuple]:
        """The last, unfilled sequence as sequences of powers of two."""
        left = [(doc, start, total, part) for doc, start, _, _, total, _, _, part in self.open]
        for bit in range(self.fill.bit_length() - 1, -1, -1):
            if not self.fill >> bit & 1:
                continue
            at = 0
            while at < 1 << bit:
                doc, start, total, part = left.pop(0)
                n = min((1 << bit) - at, len(part) // 4)
                if 4 * n < len(part):
                    left.insert(0, (doc, start + n, total, part[4 * n :]))
                yield doc, start, n, zlib.crc32(part[: 4 * n]), total, self.sequence, at, part[: 4 * n]
                at += n
            self.sequence += 1
        self.open, self.fill = [], 0


_PIECE = (("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()))


def along_curve(documents: DataFrame) -> DataFrame:
    """doc_id and packed (the text as Zstandard), dealt in order of the Hilbert key and sorted by it."""
    small_batches(documents.sparkSession)

    def keyed(ranges: Ranges | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            r, packer = projection(), zstandard.ZstdCompressor(level=1)
            for b in batches:
                texts = b.column("text").to_pylist()
                v = np.array([vector(t) for t in texts]).reshape(-1, BUCKETS) @ r
                key = hilbert(np.clip((0.5 + v / 4) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))
                part = np.zeros(len(key), np.int32) if ranges is None else ranges.part(key, ints(b.column("doc_id")))
                small = [None if ranges is None else packer.compress(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), b.column("doc_id"), b.column("tie"), pa.array(small, pa.binary()), pa.array(part)], ["key", "doc_id", "tie", "packed", "part"])

        return run

    text, row, n = text_of(documents), "key long, doc_id long, tie long, packed binary, part int", partitions(documents)
    d = only(documents, doc_id=documents["doc_id"].cast("long"), tie=F.xxhash64(text), text=text)
    known = map_batches(sampled(d, 20_000), keyed(None), row).select("key", "doc_id").limit(40_000).toArrow()  # bounded; affects the balance only
    ranges = Ranges(known["key"].to_numpy(), ints(known["doc_id"].combine_chunks()), n)
    return map_batches(d, keyed(ranges), row).repartitionById(n, F.col("part")).sortWithinPartitions("key", "doc_id", "tie").select("doc_id", "packed")


def pack(documents: DataFrame, ranks_path: str, length: int = LENGTH, ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences, with their ids on demand."""
    keep = _PIECE if ids else _PIECE[:-1]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * ids

    def table(pieces: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pieces], t) for k, (_, t) in enumerate(keep)], [n for n, _ in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e, p, end = encoder(ranks_path), Packer(TaskContext.get().partitionId() << 32, length), END_ID.to_bytes(4, "little")
        for b in batches:
            made = [x for doc, data in zip(b.column("doc_id").to_pylist(), b.column("packed").to_pylist(), strict=True) for x in p.add(doc, e.ids(unpacked(data).decode()) + end)]
            if made:
                yield table(made)
        yield table(list(p.close()))

    return map_batches(along_curve(documents), run, schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), ids=False)
