"""Tables whose rows are kept in parts by their merge key, so that a run reads and rewrites only the parts that its rows fall in.

A part is a folder. Rows of one ``home`` value (a company) stand in ``slots`` parts by their whole key, so that a company with very
many rows is shared by several; rows without a key are in parts of their own, which are added to and never rewritten. Parts are
replaced by Spark's dynamic partition overwrite: new files are written beside the old ones and take their places when the job
commits, so a job that fails leaves the table as it was, and tasks of lost executors are repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART = "part"


@dataclass(frozen=True)
class StoredTable:
    """path: folder; schema: columns as DDL; home, keys: see above; keyed: SQL condition under which a row has a key."""

    path: str
    schema: str
    home: str
    keys: tuple[str, ...]
    keyed: str = "true"
    buckets: int = 64
    slots: int = 4

    def _bucket(self, home: Column) -> Column:
        return F.pmod(F.xxhash64(home), F.lit(self.buckets)).cast("int")

    def part(self) -> Column:
        slot = F.pmod(F.xxhash64(*self.keys), F.lit(self.slots)).cast("int")
        return F.when(F.expr(self.keyed), self._bucket(F.col(self.home)) * self.slots + slot).otherwise(self.buckets * self.slots + self._bucket(F.col(self.home)))

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, self.part())

    def parts_of_keys(self, rows: DataFrame) -> list[int]:
        """Parts that hold the keys of these rows, at most buckets * slots."""
        return sorted(r[0] for r in rows.where(self.keyed).select(self.part()).distinct().collect())

    def parts_of_homes(self, homes: DataFrame) -> list[int]:
        """All parts that can hold rows of these home values (the only column of homes)."""
        found = sorted(r[0] for r in homes.select(self._bucket(F.col(homes.columns[0]))).distinct().collect())
        return [b * self.slots + s for b in found for s in range(self.slots)] + [self.buckets * self.slots + b for b in found]

    def create(self, rows: DataFrame) -> StoredTable:
        """The table with these rows; it mustn't be there yet."""
        self._write(rows, "errorifexists")
        return self

    def read(self, spark: SparkSession, parts: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some parts; others aren't read."""
        df = spark.read.schema(f"{self.schema}, {PART} int").parquet(self.path)
        return (df if parts is None else df.where(F.col(PART).isin(list(parts)))).drop(PART)

    def _write(self, rows: DataFrame, mode: str) -> None:
        names = [f.name for f in rows.sparkSession.createDataFrame([], self.schema).schema]
        missing = [c for c in names if c not in rows.columns]
        full = rows.withColumns({c: F.lit(None) for c in missing}) if missing else rows
        cast = full.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in rows.sparkSession.createDataFrame([], self.schema).schema))
        # few files a part: small parts share a task, a large one is split
        self.placed(cast).hint("rebalance", PART).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def replace(self, parts: list[int], rows: DataFrame) -> None:
        """These parts hold these rows from now on, and no others; the rows may come from the parts themselves."""
        if not parts:
            return
        spark = rows.sparkSession
        before = self._files(spark, parts)
        self._write(rows, "overwrite")
        self._drop(spark, sorted({p for p, f in before & self._files(spark, parts)}))  # what wasn't replaced has no rows any more

    def _files(self, spark: SparkSession, parts: list[int]) -> set[tuple[int, str]]:
        """Part and name of each data file of these parts."""
        files = self.read(spark, parts).inputFiles()
        return {(int(m[1]), m[2]) for f in files if (m := re.search(rf"/{PART}=(\d+)/([^/]+)$", f)) and int(m[1]) in set(parts)}

    def _drop(self, spark: SparkSession, parts: list[int]) -> None:
        """Folders of parts that have no rows any more."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        for p in parts:
            folder = hadoop.Path(f"{self.path}/{PART}={p}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
