"""Writers of tables, exports, indexes and snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = {"ratings": ["agency"], "financials": ["data_source"]}


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one that the session names, or in a temporary one where it names none and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.gettempdir()}"
    return f"{named.rstrip('/')}/creditlake-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written once to a new folder of ``scratch`` and read back, so that whatever follows sees the same rows. Columns without a type are put back as nulls."""
    path, untyped = scratch(df.sparkSession), {c for c, kind in df.dtypes if kind == "void"}
    held = df.drop(*untyped)
    held.write.parquet(path)
    back = df.sparkSession.read.schema(held.schema).parquet(path)
    return back.select(*(F.lit(None).alias(c) if c in untyped else F.col(f"`{c}`") for c in df.columns))


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> str:
    """df as parquet under root; ratings by agency, financials by data_source, in few files for each."""
    path = f"{root.rstrip('/')}/{name}"
    by = PARTITIONS.get(name, [])
    df.write.mode(mode).partitionBy(*by).parquet(path)
    return path


def export_screen(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """The screen without ids, as CSV with headers or parquet."""
    out = df.drop("company_id")
    out.write.mode("overwrite").csv(path, header=True) if fmt == "csv" else out.write.mode("overwrite").parquet(path)
    return path


def save_index(index: DataFrame, last_date: str, path: str) -> None:
    """A name index and the date up to which it was built."""
    index.write.mode("overwrite").parquet(f"{path}/index")
    index.sparkSession.range(1).select(F.lit(last_date).alias("last_date")).write.mode("overwrite").parquet(f"{path}/state")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    return spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/state").first().last_date


def write_backup(df: DataFrame, path: str) -> str:
    """A snapshot; an existing one is an error, not overwritten."""
    df.write.mode("errorifexists").parquet(path)
    return path
