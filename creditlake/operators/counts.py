"""Exact distinct counts that add up over loads: each load keeps bitmaps of the ids that it saw, and counts never read old rows again.

An id is a bit of one of many bitmaps of 32,768 bits, so a load keeps 4 KB for each bitmap that it touches, whatever its number of rows;
ids are numbered densely (``merge.assign_ids``), so bitmaps are full ones. Bitmaps of several loads are combined by bitwise or: an
id that many loads saw counts once. A load is kept under its number, and one that is kept again replaces itself. Rows that are
deleted later stay counted until their loads are kept anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def distinct_bitmaps(rows: DataFrame, column: str, **labels: Column) -> DataFrame:
    """labels, bucket, ids (bitmap), n (rows), of the ids in a column; null ids count as rows only, in a bucket of their own."""
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.coalesce(column, F.lit(1))))
    made = rows.select(F.col(column).cast("long").alias(column), *(v.alias(k) for k, v in labels.items()))
    return made.groupBy(*labels, F.bitmap_bucket_number(column).alias("bucket")).agg(F.when(F.max(column).isNotNull(), bits).alias("ids"), F.count(F.lit(1)).alias("n"))


def counted(kept: DataFrame, *labels: str) -> DataFrame:
    """labels, distinct, n: ids and rows over all loads. kept: what distinct_bitmaps made, of any number of loads."""
    merged = kept.groupBy(*labels, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("ids")).alias("distinct"), F.sum("n").alias("n"))
    return merged.groupBy(*labels).agg(F.sum(F.when(F.col("bucket").isNotNull(), F.col("distinct")).otherwise(0)).alias("distinct"), F.sum("n").alias("n"))


def keep_load(path: str, load: int, companies: DataFrame, ratings: DataFrame, financials: DataFrame) -> None:
    """Bitmaps and row counts of one load's new rows of the three tables, and its latest scrape."""
    nothing = F.lit(None).cast("string")
    all_ = (
        distinct_bitmaps(companies, "id", table_name=F.lit("companies"), data_source=nothing)
        .unionByName(distinct_bitmaps(ratings, "company_id", table_name=F.lit("ratings"), data_source=nothing))
        .unionByName(distinct_bitmaps(financials, "company_id", table_name=F.lit("financials"), data_source=F.col("data_source")))
    )
    all_.coalesce(1).write.mode("overwrite").parquet(f"{path}/bitmaps/load={load}")  # some KB a bitmap
    ratings.agg(F.max("scraped_at").alias("last_scraped")).write.mode("overwrite").parquet(f"{path}/scraped/load={load}")


def kept_summary(spark: SparkSession, path: str) -> DataFrame:
    """``reports.summary_stats`` over all loads, from what they kept."""
    c = counted(spark.read.parquet(f"{path}/bitmaps"), "table_name")

    def of(table: str, what: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("table_name") == table, F.col(what))), F.lit(0))

    one = c.agg(of("companies", "n").alias("companies"), of("ratings", "distinct").alias("rated"), of("ratings", "n").alias("ratings"), of("financials", "distinct").alias("with_financials"))
    return one.join(F.broadcast(spark.read.parquet(f"{path}/scraped").agg(F.max("last_scraped").alias("last_scraped"))))  # one row each


def kept_by_source(spark: SparkSession, path: str) -> DataFrame:
    """``reports.financials_by_source`` over all loads, from what they kept."""
    kept = spark.read.parquet(f"{path}/bitmaps").where("table_name = 'financials'")
    return counted(kept, "data_source").select("data_source", "n", F.col("distinct").alias("companies"))
