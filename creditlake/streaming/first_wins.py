"""First-wins over a stream of landed ratings: the state keeps each key's best row so far, and nothing else is looked at.

A key is company, agency and source_id; a row without a source_id is its own key, by its arrival number. A row goes on if its key is
new or if it comes before the row that the key has, so files that land out of order give what a batch over all of them gives, and
files that land again change nothing. It is a streaming aggregate, so rows meet their state without leaving the JVM, and no
Python is called for a key. State is one row a key, kept by RocksDB on the executors' disks and in the checkpoint. A
checkpoint of the former state (one number a key) can't go on: read all files again into a new table and checkpoint.

Each micro-batch is written to a folder of its own, which is replaced if the batch runs again, so a restart neither loses nor doubles
a row. A table is read by taking each key's first row; only a key that was corrected has more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = "first_wins_key"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_wins_key() -> Column:
    """Company, agency and source_id, or the arrival number of a row that has none, as one text, so that nulls are keys like others."""
    source = F.nullif(F.col("source_id"), F.lit(""))
    return F.to_json(F.struct("company_id", "agency", source.alias("source_id"), F.when(source.isNull(), F.col("seq")).alias("seq")))


def first_wins(rows: DataFrame) -> DataFrame:
    """Rows of a stream (company_id, agency, source_id, seq and others) that are their key's first so far. Null companies or agencies are keys too.

    Each best row is kept with the time of its micro-batch, which Spark logs and repeats if the batch runs again. A row with
    the same seq doesn't replace it, so what a batch improved is what bears its time.
    """
    dated = rows.withColumn(KEY, first_wins_key()).withColumn("_at", F.current_timestamp())
    kept = dated.groupBy(KEY).agg(F.min_by(F.struct(*rows.columns, "_at"), F.struct("seq", "_at")).alias("_r"))
    return kept.where(F.col("_r._at") == F.current_timestamp()).select(*(f"_r.{c}" for c in rows.columns), KEY)


def stream_first_wins(spark: SparkSession, path: str, schema: str, table: str, checkpoint: str, files: int | None = None) -> StreamingQuery:
    """Landed JSON files (with ``seq``) into the table's batches, all that is there, so many files a batch; goes on where it stopped."""
    session = spark.newSession()  # the state store is this stream's own setting
    session.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    reader = session.readStream.schema(schema)
    rows = (reader if files is None else reader.option("maxFilesPerTrigger", files)).json(path)

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={n}")

    return first_wins(rows).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_first_wins(spark: SparkSession, schema: str, table: str) -> DataFrame:
    """The table as a batch over all files would have made it."""
    rows = spark.read.schema(f"{schema}, {KEY} string").parquet(table)
    payload = [c for c in rows.columns if c not in (KEY, "batch")]
    return rows.groupBy(KEY).agg(F.min_by(F.struct(*payload), "seq").alias("_r")).select("_r.*")
