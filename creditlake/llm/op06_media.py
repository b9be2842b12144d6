"""Media columns: bytes kept as Netpbm or BMP images, decoded to arrays, area-resized, tiled as NPY and hashed.

``decode`` reads binary PBM, PGM and PPM (8-bit) and uncompressed BMP of 8 or 24 bits. ``area_resize`` averages exact areas from an
integral image. ``difference_hash`` compares neighbours of a 9 × 8 reduction. ``npy_tiles`` cuts an array into NPY tiles.

Every row is worked on by itself, so nothing is exchanged. Defined cases: null text is the empty text (a payload of 576 bytes 255);
equal texts give equal values; a null doc_id is returned as null; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from creditlake.llm.common import map_batches, only, read, small_batches, text_of

#: Payloads are padded to a multiple of UNIT bytes with PAD: whole rows of 24 samples, and 24 rows at least.
UNIT, PAD, WIDTH = 576, 255, 24
TILE = 32
_HEADER = re.compile(rb"P([456])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?\s")


class MediaError(ValueError):
    """The bytes aren't an image in a form that is read here."""


def encode_netpbm(a: np.ndarray) -> bytes:
    """PGM for (h, w), PPM for (h, w, 3), PBM for booleans."""
    h, w = a.shape[:2]
    if a.dtype == bool:
        return b"P4\n%d %d\n" % (w, h) + np.packbits(a, axis=1).tobytes()
    return b"P%d\n%d %d\n255\n" % (6 if a.ndim == 3 else 5, w, h) + a.astype(np.uint8).tobytes()


def encode_bmp(a: np.ndarray) -> bytes:
    """An uncompressed BMP: 8 bits with a grey palette, or 24 bits; rows from the bottom, padded to 4 bytes."""
    h, w = a.shape[:2]
    deep = a.ndim == 3
    palette = b"" if deep else bytes(x for i in range(256) for x in (i, i, i, 0))
    row = np.ascontiguousarray(a[::-1, :, ::-1] if deep else a[::-1]).reshape(h, -1).astype(np.uint8)
    row = np.pad(row, ((0, 0), (0, -row.shape[1] % 4)))
    at = 54 + len(palette)
    return struct.pack("<2sIHHI", b"BM", at + row.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24 if deep else 8, 0, row.size, 2835, 2835, 0 if deep else 256, 0) + palette + row.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The samples of a Netpbm or BMP image as an array; bytes that hold no whole image raise MediaError."""
    try:
        a = _bmp(data) if data[:2] == b"BM" else _netpbm(data)
    except (struct.error, ValueError, IndexError, OverflowError) as e:
        raise e if isinstance(e, MediaError) else MediaError(str(e)) from e
    if not a.size:
        raise MediaError("no samples")
    return a


def _netpbm(data: bytes) -> np.ndarray:
    m = _HEADER.match(data)
    if not m:
        raise MediaError("neither Netpbm nor BMP")
    kind, w, h = int(m[1]), int(m[2]), int(m[3])
    if kind == 4:
        end = m.end(3) + 1
        rows = np.frombuffer(data, np.uint8, h * -(-w // 8), end).reshape(h, -1)
        return np.unpackbits(rows, axis=1)[:, :w].astype(bool)
    if m[4] is None or int(m[4]) != 255:
        raise MediaError("only 8-bit samples are read")
    n = w * h * (3 if kind == 6 else 1)
    if len(data) - m.end() < n:
        raise MediaError(f"{len(data) - m.end()} bytes of samples; {n} are due")
    return np.frombuffer(data, np.uint8, n, m.end()).reshape((h, w, 3) if kind == 6 else (h, w))


def _bmp(data: bytes) -> np.ndarray:
    _, total, _, _, at = struct.unpack_from("<2sIHHI", data)
    _, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
    if bits not in (8, 24) or packed:
        raise MediaError(f"{bits} bits, compression {packed}")
    if len(data) < total:
        raise MediaError(f"{len(data)} bytes; the header says {total}")
    wide = w * bits // 8
    rows = np.frombuffer(data, np.uint8, abs(h) * (wide + -wide % 4), at).reshape(abs(h), -1)[:, :wide]
    rows = rows[::-1] if h > 0 else rows
    if bits == 24:
        return rows.reshape(abs(h), w, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, 4 * ((at - 54) // 4), 54).reshape(-1, 4)
    return palette[:, 0][rows] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all() else palette[rows][:, :, 2::-1]


def area_resize(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """(h, w) means of exact areas of a grey array, by its integral image; areas may cut samples."""
    whole = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    np.cumsum(np.cumsum(a, axis=0, dtype=np.float64), axis=1, out=whole[1:, 1:])
    lines = _between(whole, np.linspace(0, a.shape[0], h + 1))
    cells = _between(lines.T, np.linspace(0, a.shape[1], w + 1)).T
    return np.diff(np.diff(cells, axis=0), axis=1) * (h * w / (a.shape[0] * a.shape[1]))


def _between(whole: np.ndarray, at: np.ndarray) -> np.ndarray:
    low = np.minimum(at.astype(int), len(whole) - 2)
    part = (at - low)[:, None]
    return whole[low] * (1 - part) + whole[low + 1] * part


def difference_hash(a: np.ndarray) -> int:
    """64 bits: is each cell of an 8 × 9 reduction darker than its right neighbour."""
    small = np.round(area_resize(a, 8, 9), 6)
    return int.from_bytes(np.packbits(small[:, :-1] < small[:, 1:]).tobytes(), "big")


def npy_tiles(a: np.ndarray, size: int = TILE) -> list[bytes]:
    """The array cut into tiles of at most size × size, each as an NPY file, row by row."""
    out = []
    for i in range(0, a.shape[0], size):
        for j in range(0, a.shape[1], size):
            np.save(f := io.BytesIO(), np.ascontiguousarray(a[i : i + size, j : j + size]))
            out.append(f.getvalue())
    return out


def store(payload: bytes) -> bytes:
    """The payload as samples 24 wide, as BMP or PGM by its checksum, so that both forms are in use at every length."""
    a = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_netpbm(a) if zlib.crc32(payload) & 1 else encode_bmp(a)


def padded(data: bytes) -> bytes:
    return data + bytes([PAD]) * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def feature(a: np.ndarray) -> str:
    """Difference hash, and a checksum of the NPY tiles of the 64 × 64 reduction."""
    tiles = npy_tiles(np.round(area_resize(a, 64, 64)).astype(np.uint8))
    return f"{difference_hash(a):016x}-{len(tiles)}-{zlib.crc32(b''.join(tiles)):08x}"


def media_tiles(documents: DataFrame) -> DataFrame:
    """doc_id, media (the stored image), tile (from 0), npy (an NPY tile of the image's 64 × 64 reduction), dhash."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                media = store(padded(text.encode()))
                a = decode(media)
                out += [(doc, media, k, t, f"{difference_hash(a):016x}") for k, t in enumerate(npy_tiles(np.round(area_resize(a, 64, 64)).astype(np.uint8)))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.string()), strict=True)], ["doc_id", "media", "tile", "npy", "dhash"])

    return map_batches(only(documents, doc_id=documents["doc_id"].cast("long"), text=text_of(documents)), run, "doc_id long, media binary, tile int, npy binary, dhash string")


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(text: str) -> tuple:
    data = text.encode()
    media = store(padded(data))
    a = decode(media)
    back = a.tobytes()
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(a)


def media_digests(documents: DataFrame) -> DataFrame:
    """What the stored images give when they are read back, as digests, and their features."""
    small_batches(documents.sparkSession)
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_digest(t) for t in b.column("text").to_pylist()]
            if made:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True))], [x.split()[0] for x in _DIGESTS.split(", ")])

    return map_batches(only(documents, doc_id=documents["doc_id"].cast("long"), text=text_of(documents)), run, _DIGESTS)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read(spark, sf_dir, "documents"))
