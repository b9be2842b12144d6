"""Counts, clean-up and checks over the four tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.functions.names import sector_group
from creditlake.operators.merge import keep_first


def summary_stats(companies: DataFrame, ratings: DataFrame, financials: DataFrame) -> DataFrame:
    """One row: companies, rated companies, companies with financials, ratings, latest scrape."""
    c = companies.agg(F.count(F.lit(1)).alias("companies"))
    r = ratings.agg(F.countDistinct("company_id").alias("rated"), F.count(F.lit(1)).alias("ratings"), F.max("scraped_at").alias("last_scraped"))
    f = financials.agg(F.countDistinct("company_id").alias("with_financials"))
    return c.crossJoin(r).crossJoin(f)  # three rows of one


def distinct_sectors(ratings: DataFrame) -> DataFrame:
    return ratings.select("sector").where(F.coalesce("sector", F.lit("")) != "").distinct().orderBy("sector")


def distinct_agencies(ratings: DataFrame) -> DataFrame:
    return ratings.select("agency").where(F.col("agency").isNotNull()).distinct().orderBy("agency")


def ratings_by_agency(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("agency").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "agency")


def financials_by_source(financials: DataFrame) -> DataFrame:
    return financials.groupBy("data_source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("company_id").alias("companies"))


def table_counts(**tables: DataFrame) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sectors_by_group(ratings: DataFrame) -> DataFrame:
    """Sectors of each group, sorted."""
    s = distinct_sectors(ratings).withColumn("sector_group", sector_group(F.col("sector")))
    return s.groupBy("sector_group").agg(F.sort_array(F.collect_set("sector")).alias("sectors"), F.count(F.lit(1)).alias("n"))


def orphans(child: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows whose company isn't there."""
    return child.join(companies.select(F.col("id").alias("company_id")), "company_id", "left_anti")


FINANCIAL_KEY = ["company_id", "fiscal_year", "data_source"]


def drop_duplicate_financials(financials: DataFrame) -> DataFrame:
    return keep_first(financials, FINANCIAL_KEY)


def drop_rating_shells(ratings: DataFrame) -> DataFrame:
    """Without CRISIL rows that have neither source_id nor grade."""
    return ratings.where(~((F.col("agency") == "CRISIL") & F.col("source_id").isNull() & F.col("rating_grade").isNull()))


def drop_placeholders(companies: DataFrame, ratings: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """Without the companies of these ids and the ratings of those that are there; their financials stay."""
    there = companies.where(F.col("id").isin(*ids)).select(F.col("id").alias("company_id"))
    return companies.where(~F.col("id").isin(*ids)), ratings.join(there, "company_id", "left_anti")


def drop_orphans(companies: DataFrame, notes: DataFrame, ratings: DataFrame, financials: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies and notes that have a rating or financials."""
    used = ratings.select("company_id").unionByName(financials.select("company_id")).distinct()
    return companies.join(used.withColumnRenamed("company_id", "id"), "id", "left_semi"), notes.join(used, "company_id", "left_semi")


def cleanup(companies: DataFrame, ratings: DataFrame, financials: DataFrame, notes: DataFrame, placeholders: list[int]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All steps in order; the tables, and rows of each before and after."""
    before = dict(companies=companies, ratings=ratings, financials=financials, notes=notes)
    f = drop_duplicate_financials(financials)
    c, r = drop_placeholders(companies, drop_rating_shells(ratings), placeholders)
    c, n = drop_orphans(c, notes, r, f)
    after = dict(companies=c, ratings=r, financials=f, notes=n)
    report = table_counts(**before).withColumnRenamed("n", "rows_before").join(table_counts(**after).withColumnRenamed("n", "rows_after"), "table_name")
    return after, report


def run_counts(df: DataFrame, matched: str, name: str) -> DataFrame:
    """Rows processed, matched, not found, and errors (blank names)."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    return df.agg(F.count(F.lit(1)).alias("processed"), F.count_if(~blank & F.col(matched)).alias("matched"), F.count_if(~blank & ~F.col(matched)).alias("not_found"), F.count_if(blank).alias("errors"))
