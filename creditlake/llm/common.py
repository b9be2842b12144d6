"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that one Arrow batch holds at most; keeps a worker's memory bounded when texts are long.
BATCH_ROWS = 256
#: Input bytes (files, compressed) for one part of an exchange, the most parts that make sense to schedule, and Spark's size of what it can't tell.
PART_BYTES, MOST_PARTS, UNKNOWN = 256 << 20, 1 << 16, 1 << 60


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI; a temporary one only where the session names none and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as far as Spark knows them: files count, rows that were handed to Spark may not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < UNKNOWN)


def partitions(df: DataFrame) -> int:
    """Parts for an exchange of df: one for each PART_BYTES that it reads, at least the session's setting, at most MOST_PARTS."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_PARTS, -(-input_bytes(df) // PART_BYTES)))


def text_of(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def only(df: DataFrame, **columns: Column) -> DataFrame:
    """Just these columns, so that no other column of the input can clash."""
    return df.select(*(c.alias(k) for k, c in columns.items()))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches cut to BATCH_ROWS rows before fn sees them."""
    rows = BATCH_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what the JVM puts in one Arrow batch (rows of whole texts).

    Spark reads this setting when a plan runs, which is after an operator has returned, so it stays; it is never raised.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def packed(text: Column) -> Column:
    """A text as Zstandard, about a third of its size in an exchange; null stays null."""

    @F.pandas_udf("binary")
    def pack(texts):
        packer = zstandard.ZstdCompressor(level=1)
        return texts.map(lambda t: packer.compress(t.encode()), na_action="ignore")

    return pack(text)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


class Ranges:
    """Boundaries by which rows of a Python stage are dealt in order of (first, second), taken from a bounded sample.

    Spark's own range partitioner would run that stage twice, once for its sample. The sample affects the balance only. A first
    value that many rows share is spread by the second.
    """

    def __init__(self, firsts: np.ndarray, seconds: np.ndarray, parts: int):
        order = np.lexsort((seconds, firsts))
        at = order[np.arange(1, parts) * len(order) // parts] if len(order) else order
        self.firsts, self.seconds = firsts[at], seconds[at]

    def part(self, firsts: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        """How many boundaries are no greater than each row."""
        out, high = np.searchsorted(self.firsts, firsts, "left"), np.searchsorted(self.firsts, firsts, "right")
        for low in np.unique(out[out < high]).tolist():
            rows = np.flatnonzero((out == low) & (out < high))
            out[rows] += np.searchsorted(self.seconds[low : high[rows[0]]], seconds[rows], "right")
        return out.astype(np.int32)


def sampled(df: DataFrame, rows: int = 2000) -> DataFrame:
    """About so many rows of df."""
    n = df.count()
    return df.sample(min(1.0, rows / n), seed=1) if n else df


def ints(column: pa.Array, null: int = -(1 << 63)) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)
