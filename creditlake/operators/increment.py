"""Merges into stored tables that touch only what changes, and a kept screen that is refreshed for changed companies alone.

Each merge gives the same table as the merge of whole tables (``operators.merge``) and returns the ids of the companies that its
rows are about, as a frame; the kept screen reads, computes and rewrites the parts of those companies only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake import schemas
from creditlake.functions.names import normalize_name
from creditlake.operators import merge as M
from creditlake.operators.screen import SCREEN_COLUMNS, screen
from creditlake.sources.stored import StoredTable

_TEXT = {"Company Name", "Agency", "Rating", "Outlook", "Sector", "Rating Date", "Rationale URL", "BSE Code", "ISIN"}
_WHOLE = {"company_id": "long", "Grade": "int", "Listed": "int"}
SCREEN = ", ".join(f"`{c}` {'string' if c in _TEXT else _WHOLE.get(c, 'double')}" for c in SCREEN_COLUMNS)


def stored_companies(path: str, buckets: int = 64) -> StoredTable:
    return StoredTable(path, schemas.COMPANIES, "name_normalized", ("name_normalized",), buckets=buckets, slots=1)


def stored_ratings(path: str, buckets: int = 64, slots: int = 4) -> StoredTable:
    return StoredTable(path, schemas.RATINGS, "company_id", ("company_id", "agency", "source_id"), "coalesce(source_id, '') <> ''", buckets, slots)


def stored_financials(path: str, buckets: int = 64, slots: int = 4) -> StoredTable:
    return StoredTable(path, schemas.FINANCIALS, "company_id", ("company_id", "fiscal_year", "data_source"), "coalesce(fiscal_year, 0) <> 0 and coalesce(data_source, '') <> ''", buckets, slots)


def stored_screen(path: str, buckets: int = 64) -> StoredTable:
    return StoredTable(path, SCREEN, "company_id", ("company_id",), buckets=buckets, slots=1)


def upsert_into(table: StoredTable, incoming: DataFrame) -> DataFrame:
    """``merge.upsert_companies`` over the parts of the incoming names; new companies are numbered in order of arrival."""
    spark = incoming.sparkSession
    named = incoming.withColumn("name_normalized", normalize_name(F.col("name")))
    parts = table.parts_of_keys(named)
    merged = M.upsert_companies(table.read(spark, parts), incoming)
    start = table.read(spark).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    first = named.groupBy("name_normalized").agg(F.min("seq").alias("_seq"))
    new = M.assign_ids(merged.where("id is null").drop("id").join(first, "name_normalized"), ["_seq", "name_normalized"], start)
    table.replace(parts, merged.where("id is not null").unionByName(new.drop("_seq"), allowMissingColumns=True))
    return table.read(spark, parts).join(first, "name_normalized", "left_semi").select(F.col("id").alias("company_id"))


def insert_into(table: StoredTable, incoming: DataFrame) -> DataFrame:
    """``merge.insert_ratings``: what is new is added; nothing is rewritten, and only the parts of the incoming keys are read."""
    spark = incoming.sparkSession
    table.append(M.new_ratings(table.read(spark, table.parts_of_keys(incoming)), incoming))
    return incoming.select("company_id").distinct()


def merge_into(table: StoredTable, incoming: DataFrame) -> DataFrame:
    """``merge.merge_financials`` over the parts of the incoming keys; rows without a key are added."""
    spark = incoming.sparkSession
    keyed, parts = F.coalesce(F.expr(table.keyed), F.lit(False)), table.parts_of_keys(incoming)
    table.replace(parts, M.merge_financials(table.read(spark, parts), incoming.where(keyed)))
    loose = incoming.where(~keyed)
    if not loose.isEmpty():
        table.append(loose)
    return incoming.select("company_id").distinct()


def delete_from(table: StoredTable, ids: DataFrame, column: str = "company_id") -> DataFrame:
    """Rows of these companies go. ids: company_id."""
    spark, gone = ids.sparkSession, ids.select(F.col("company_id").alias("_gone")).distinct()
    rows = table.read(spark)
    if column == table.home:
        parts = table.parts_of_homes(gone)
    else:
        held = rows.join(gone, F.col(column) == F.col("_gone"), "left_semi")
        parts = table.parts_of_keys(held)
    table.replace(parts, table.read(spark, parts).join(gone, F.col(column) == F.col("_gone"), "left_anti"))
    return ids.select("company_id").distinct()


def refresh_screen(kept: StoredTable, companies: DataFrame, ratings: StoredTable, financials: StoredTable, changed: DataFrame) -> int:
    """Brings the kept screen (every company with a rating, unfiltered) up to date for the changed companies; how many parts were rewritten.

    changed: company_id. Ratings and financials are read in the parts of those companies, and rows of others there are left out
    by a semi-join before anything is aggregated.
    """
    spark, ids = changed.sparkSession, changed.select("company_id").distinct()

    def of(table: StoredTable) -> DataFrame:
        return table.read(spark, table.parts_of_homes(ids)).join(ids, "company_id", "left_semi")

    own = companies.join(ids, companies["id"] == ids["company_id"], "left_semi")
    fresh = screen(own, of(ratings), of(financials), None, order=False)
    parts = kept.parts_of_homes(ids)
    kept.replace(parts, kept.read(spark, parts).join(ids, "company_id", "left_anti").unionByName(fresh))
    return len(parts)
