"""Progress of incremental runs, and a file-source stream that feeds the same merges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from creditlake.functions.names import strip_suffix


def build_name_index(docs: DataFrame, existing: DataFrame, last_date: str) -> DataFrame:
    """existing and the first new document of each key that it doesn't have. docs: chunk_date, pos, name, file; existing: key, name, file."""
    new = docs.where(F.col("chunk_date") > F.lit(last_date).cast("date")).withColumn("key", strip_suffix(F.col("name")))
    first = new.groupBy("key").agg(F.min_by(F.struct("name", "file"), F.struct("chunk_date", "pos")).alias("r")).select("key", "r.*")
    return existing.select("key", "name", "file").unionByName(first.join(existing.select("key"), "key", "left_anti").select("key", "name", "file"))


def date_chunks(start: Column, end: Column, monthly: bool) -> Column:
    """Array of structs (first, last) as MM/dd/yyyy: days, or months from the first of the start's month, the last cut at the end."""
    step = F.expr("interval 1 month" if monthly else "interval 1 day")
    days = F.sequence(F.trunc(start, "month") if monthly else start, end, step)

    def last(d: Column) -> Column:
        return F.least(F.last_day(d), end) if monthly else d

    return F.transform(days, lambda d: F.struct(F.date_format(d, "MM/dd/yyyy").alias("first"), F.date_format(last(d), "MM/dd/yyyy").alias("last")))


def after_checkpoint(df: DataFrame, key: str, checkpoint: int, most: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows whose key is a number past the checkpoint, up to the last id and by no more than ``limit`` numbers if given, in numeric order."""
    n = F.col(key).try_cast("long")
    out = df.where(n > checkpoint)
    if limit is not None:
        most = checkpoint + limit if most is None else min(most, checkpoint + limit)
    return (out if most is None else out.where(n <= most)).orderBy(n)


def next_checkpoint(done: DataFrame, key: str, checkpoint: int) -> int:
    """The largest key that was done, or the old checkpoint."""
    return done.agg(F.coalesce(F.max(F.col(key).try_cast("long")), F.lit(checkpoint))).first()[0]


def prefix_bucket(name: Column) -> Column:
    """First two letters of a name, lower case; '' if it doesn't start with two letters."""
    return F.regexp_extract(F.lower(name), "^([a-z]{2})", 1)


def run_pipeline(steps: list[tuple[str, Callable[[], object]]], chosen: set[str] | None = None) -> dict[str, object]:
    """Steps in their fixed order, all or the chosen ones; what each returned."""
    return {name: step() for name, step in steps if chosen is None or name in chosen}


def stream_ingest(spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Landed JSON files through ``merge``, a batch at a time; offsets are kept, so a restart goes on where it stopped."""
    return spark.readStream.schema(schema).json(path).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
