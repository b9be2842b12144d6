"""WARC archives in Zstandard: one frame a record, a shared dictionary in a leading skippable frame.

``write_archives`` marks repeated payloads as revisits of the largest page_id that holds them, and each task writes archives of
bounded size to the shared folder. ``read_archives`` loads them with Spark's binary reader, takes the dictionary from the leading
skippable frame, decodes frame by frame and checks versions, headers, digests and lengths; a broken archive raises.

Payload digests are compared, payloads never gathered: the largest page_id of each digest is a partial aggregate, joined back.

Defined cases: null html is the empty payload; a null page_id is written as an empty id and read back as null, and ranks below all
others; rows that repeat a page_id are records of their own, and those with its largest payload all stay responses; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm.common import map_batches, only, read, shared_dir, small_batches

MIN_REVISIT = 1000  #: bytes of payload from which a repeat is a revisit
ARCHIVE_BYTES = 16 << 20  #: compressed bytes after which a task begins another archive
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 4000, 32 << 10  #: bounds of what the dictionary is trained on, and of itself
MAGIC = 0x184D2A5D  #: fixed: the skippable frame that holds a WARC dictionary
END = b"\r\n\r\n"


class ArchiveError(ValueError):
    """An archive that doesn't hold what its headers say."""


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit that carries the HTTP header of the payload it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url}')}>",
        "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {url.replace(chr(13), '').replace(chr(10), '')}", f"X-Page-ID: {name}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def records(archive: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, each one record."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != MAGIC or len(archive) < 8 + size:
        raise ArchiveError("no leading dictionary frame")
    dictionary = archive[8 : 8 + size]
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if size else None)
    view, at = memoryview(archive), 8 + size
    while at < len(archive):
        d = decoder.decompressobj()
        step, parts = 1 << 16, []
        while not d.eof:
            if at >= len(archive):
                raise ArchiveError("the last frame is cut off")
            parts.append(d.decompress(view[at : at + step]))
            at += step
        at -= len(d.unused_data) + max(0, at - len(archive))
        yield b"".join(parts)


def headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise ArchiveError(f"no header: {line[:80]!r}")
        out[k.decode().lower()] = v.decode().strip()
    return out


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page_id, payload length, payload digest, record type, refers_to, payload; everything stated twice is compared."""
    head, end, rest = data.partition(END)
    version, _, lines = head.partition(b"\r\n")
    if version != b"WARC/1.1" or not end:
        raise ArchiveError(f"no WARC/1.1 record: {version[:40]!r}")
    h = headers(lines)
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != END:
        raise ArchiveError(f"{len(rest) - 4} bytes of block; the header says {size}")
    http, end, payload = rest[:size].partition(END)
    if not end:
        raise ArchiveError("no HTTP header")
    length, digest = int(headers(http.partition(b"\r\n")[2])["content-length"]), h["warc-payload-digest"].removeprefix("sha1:")
    kind = h["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ArchiveError("the payload isn't what its headers say")
    if kind not in ("response", "revisit") or (kind == "revisit" and payload):
        raise ArchiveError(f"a {kind} with {len(payload)} bytes of payload")
    refers = h.get("x-refers-to-page-id")
    return int(h["x-page-id"]) if h["x-page-id"] else None, length, digest, kind, int(refers) if refers else None, payload


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the first SAMPLE_CHARS characters of at most SAMPLE_PAGES pages; empty if there are too few."""
    rows = pages.select(F.substring(F.col("html"), 1, SAMPLE_CHARS).alias("s")).where("length(s) > 200").limit(SAMPLE_PAGES).collect()
    samples = [r.s.encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 20 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def archive(rows: Iterable[tuple], dictionary: bytes) -> Iterator[tuple[bytes, int]]:
    """Archives (bytes, records) of at most about ARCHIVE_BYTES each."""
    packer = zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    parts, size = [], 0
    for row in rows:
        parts.append(packer.compress(record(*row)))
        size += len(parts[-1])
        if size >= ARCHIVE_BYTES:
            yield dictionary_frame(dictionary) + b"".join(parts), len(parts)
            parts, size = [], 0
    if parts:
        yield dictionary_frame(dictionary) + b"".join(parts), len(parts)


def _put(uri: str, data: bytes) -> None:
    """Writes under another name first, so that a lost attempt leaves no half archive."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0])
    part = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def with_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses)."""
    p = only(pages, page_id=pages["page_id"].cast("long"), url=F.coalesce(pages["url"], F.lit("")), html=F.coalesce(pages["html"], F.lit("")))
    p = p.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    best = p.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "largest")
    # Only ids and digests meet; payloads go once to where their row's verdict is.
    narrow = p.select("page_id", "digest").join(best.hint("merge"), "digest").where(~F.col("page_id").eqNullSafe(F.col("largest"))).select("page_id", "digest", F.col("largest").alias("refers_to")).distinct()
    right = narrow.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to").hint("merge")
    return p.join(right, p["page_id"].eqNullSafe(right["_page"]) & (p["digest"] == right["_digest"]), "left").select("page_id", "url", "html", "digest", "refers_to")


def write_archives(pages: DataFrame, to: str | None = None, min_bytes: int = MIN_REVISIT) -> str:
    """Writes pages as WARC archives under a URI and returns it."""
    spark = pages.sparkSession
    small_batches(spark)
    to = to or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    dictionary = train_dictionary(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = ((i, u, h.encode(), d, r) for b in batches for i, u, h, d, r in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True))
        for k, (data, n) in enumerate(archive(rows, dictionary)):
            _put(f"{to}/{part:06d}-{k:06d}.warc.zst", data)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["records"])

    # In a fixed order, so that a task that runs again cuts its rows into the same archives and replaces those of the lost attempt.
    rows_ = with_originals(pages, min_bytes).sortWithinPartitions("page_id", "digest", "url")
    map_batches(rows_, run, "records long").agg(F.sum("records")).collect()
    return to


def read_archives(spark: SparkSession, uri: str, payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; on demand its payload too."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())[: 5 + payload]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                rows: list[tuple] = []
                for r in records(data.as_py()):
                    rows.append(parse(r)[: len(types)])
                    if len(rows) == 2048:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(uri).select("content")
    except Exception as e:  # noqa: BLE001  an empty table has no archive, and so no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return files.mapInArrow(run, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(spark, write_archives(read(spark, sf_dir, "pages")))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
m AS (SELECT digest, max(page_id) AS largest FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN m.largest IS NULL OR m.largest = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m.largest <> d.page_id THEN m.largest END AS refers_to
FROM d LEFT JOIN m ON d.digest = m.digest AND d.n >= 1000
"""
