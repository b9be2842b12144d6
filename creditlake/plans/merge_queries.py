"""Queries of writes and merges. Half of the rows are there already, the others arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlake.operators import merge as M
from creditlake.plans import adapters as A
from creditlake.plans.adapters import sql_name, with_tables
from creditlake.plans.registry import query

_NAMES = f"""WITH inc AS (SELECT o_orderkey AS seq, c_name || CASE o_orderkey % 2 WHEN 0 THEN ' Limited' ELSE ' LTD' END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'I' || o_orderkey END AS isin,
  CASE WHEN o_orderkey % 4 = 0 THEN 'B' || o_orderkey END AS bse_code, CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 2 END AS INTEGER) AS is_listed FROM orders JOIN customer ON o_custkey = c_custkey),
al AS (SELECT -1 AS seq, id, name, name_normalized, isin, NULL AS bse_code, is_listed FROM companies WHERE id % 2 = 0 UNION ALL SELECT seq, NULL, name, {sql_name('name')}, isin, bse_code, is_listed FROM inc)
SELECT name_normalized, max(id) AS id, arg_min(name, seq) AS name, arg_max(isin, seq) FILTER (isin IS NOT NULL) AS isin, arg_max(bse_code, seq) FILTER (bse_code IS NOT NULL) AS bse_code,
  coalesce(arg_max(is_listed, seq) FILTER (is_listed IS NOT NULL), 0) AS is_listed FROM al GROUP BY name_normalized"""


@query("upsert_companies", with_tables(_NAMES, "companies"))
def _(spark, sf):
    key = F.col("o_orderkey")
    o = A.read(spark, sf, "orders").join(A.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    inc = o.select(
        key.alias("seq"), F.concat("c_name", F.when(key % 2 == 0, F.lit(" Limited")).otherwise(F.lit(" LTD"))).alias("name"), F.when(key % 3 == 0, F.concat(F.lit("I"), key.cast("string"))).alias("isin"),
        F.when(key % 4 == 0, F.concat(F.lit("B"), key.cast("string"))).alias("bse_code"), F.when(key % 5 == 0, (key % 2).cast("int")).alias("is_listed"),
    )
    return M.upsert_companies(A.companies(spark, sf).where("id % 2 = 0"), inc).select("name_normalized", "id", "name", "isin", "bse_code", "is_listed")


_RATED = """WITH ex AS (SELECT * FROM ratings WHERE id % 2 = 0), inc AS (SELECT * FROM ratings WHERE id % 2 = 1)
SELECT company_id, agency, source_id, rating_symbol, rating_date FROM ex UNION ALL SELECT company_id, agency, source_id, rating_symbol, rating_date FROM inc WHERE source_id IS NULL
UNION ALL SELECT company_id, agency, source_id, arg_min(coalesce(rating_symbol, '?'), id), arg_min(coalesce(rating_date, '?'), id) FROM inc WHERE source_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.company_id = inc.company_id AND ex.agency = inc.agency AND ex.source_id = inc.source_id) GROUP BY company_id, agency, source_id"""


@query("insert_ratings", with_tables(f"SELECT company_id, agency, source_id, nullif(rating_symbol, '?') AS rating_symbol, nullif(rating_date, '?') AS rating_date FROM ({_RATED.replace('WITH ex', 'WITH ex')})", "ratings"))
def _(spark, sf):
    r = A.ratings(spark, sf)
    inc = r.where("id % 2 = 1").withColumnRenamed("id", "seq")
    return M.insert_ratings(r.where("id % 2 = 0"), inc).select("company_id", "agency", "source_id", "rating_symbol", "rating_date")


_BEST = """WITH al AS (SELECT *, CASE WHEN id % 2 = 0 THEN -1 ELSE id END AS seq, CASE WHEN id % 11 = 0 THEN NULL ELSE fiscal_year END AS fy FROM financials)
SELECT company_id, fy AS fiscal_year, data_source, revenue_cr, extraction_confidence FROM (SELECT *, row_number() OVER (PARTITION BY company_id, fy, data_source ORDER BY coalesce(extraction_confidence, 0) DESC, seq, id) AS k FROM al WHERE fy IS NOT NULL) WHERE k = 1
UNION ALL SELECT company_id, fy, data_source, revenue_cr, extraction_confidence FROM al WHERE fy IS NULL"""


@query("merge_financials", with_tables(_BEST, "financials"))
def _(spark, sf):
    f = A.financials(spark, sf).withColumn("fiscal_year", F.when(F.col("id") % 11 != 0, F.col("fiscal_year")))
    inc = f.where("id % 2 = 1").withColumn("seq", F.col("id")).drop("id")
    return M.merge_financials(f.where("id % 2 = 0"), inc).select("company_id", "fiscal_year", "data_source", "revenue_cr", "extraction_confidence")


@query("override_sector", with_tables("SELECT id, CASE WHEN company_id % 10 = 0 THEN '' WHEN company_id % 5 = 0 THEN 'New sector' ELSE sector END AS sector FROM ratings", "ratings"))
def _(spark, sf):
    o = A.companies(spark, sf).where("id % 5 = 0").select(F.col("id").alias("company_id"), F.when(F.col("id") % 10 != 0, F.lit("  New sector ")).alias("sector"))
    return M.override_sector(A.ratings(spark, sf), o).select("id", "sector")


@query("fill_missing_sector", with_tables("SELECT id, CASE WHEN agency = 'CRISIL' AND coalesce(sector, '') = '' AND company_id % 2 = 0 THEN 'Hotels' ELSE sector END AS sector FROM ratings", "ratings"))
def _(spark, sf):
    d = A.companies(spark, sf).where("id % 2 = 0").select(F.col("id").alias("company_id"), F.lit("Hotels").alias("sector"))
    return M.fill_missing_sector(A.ratings(spark, sf), d, "CRISIL").select("id", "sector")


_EDITS = "e AS (SELECT c_custkey AS company_id, CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'edit ' || c_custkey END AS note FROM customer WHERE c_custkey % 6 < 2)"


@query("apply_note_edits", with_tables(f"WITH {_EDITS} SELECT * FROM (SELECT coalesce(n.company_id, e.company_id) AS company_id, coalesce(e.note, n.note) AS note FROM notes n FULL JOIN e ON n.company_id = e.company_id) WHERE note <> ''", "notes"))
def _(spark, sf):
    key = F.col("c_custkey")
    e = A.read(spark, sf, "customer").where(key % 6 < 2).select(key.alias("company_id"), F.when(key % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" edit "), key.cast("string"))).alias("note"))
    return M.apply_note_edits(A.notes(spark, sf), e)


@query("replace_notes", "SELECT c_custkey AS company_id, c_mktsegment AS note FROM customer WHERE c_custkey % 3 <> 0")
def _(spark, sf):
    key = F.col("c_custkey")
    return M.replace_notes(A.read(spark, sf, "customer").select(key.alias("company_id"), F.when(key % 3 == 0, F.lit(" \t")).otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("\n"))).alias("note")))


for _exchange, _isin, _code in (("BSE", "coalesce(m.isin, c.isin)", "m.code"), ("NSE", "c.isin", "m.code")):
    _SQL = f"SELECT c.id, CASE WHEN m.code IS NULL THEN c.isin ELSE {_isin} END AS isin, {_code} AS bse_code, CASE WHEN m.code IS NULL THEN c.is_listed ELSE 1 END AS is_listed FROM companies c LEFT JOIN refs m ON c.id = m.pos"

    @query(f"mark_listed_{_exchange.lower()}", with_tables(_SQL, "companies", "refs"))
    def _(spark, sf, exchange=_exchange):
        m = A.references(spark, sf).select(F.col("pos").alias("company_id"), F.col("isin").alias("ref_isin"), F.col("code").alias("ref_code"))
        return M.mark_listed(A.companies(spark, sf), m, exchange).select("id", "isin", "bse_code", "is_listed")


@query("assign_ids", "SELECT event_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def _(spark, sf):
    return M.assign_ids(A.read(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"], 1000).select("event_id", "id")


@query("keep_first", with_tables("SELECT min(id) AS id FROM ratings GROUP BY company_id, source_id", "ratings"))
def _(spark, sf):
    return M.keep_first(A.ratings(spark, sf), ["company_id", "source_id"]).select("id")


@query("union_agencies", with_tables("SELECT agency, id FROM ratings", "ratings"))
def _(spark, sf):
    r = A.ratings(spark, sf)
    return M.union_ratings(*(r.where(F.col("agency") == a).select(*(("id", "agency") if a == "ICRA" else ("agency", "id"))) for a in A.AGENCIES))
