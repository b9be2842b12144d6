"""Queries of stored tables: rows arrive in two loads after a first half, and each load touches its own parts only."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlake.operators import counts as N
from creditlake.operators import increment as I
from creditlake.operators import screen as S
from creditlake.plans import adapters as A
from creditlake.plans.adapters import CTES, sql_name, with_tables
from creditlake.plans.registry import query
from creditlake.plans.source_queries import scratch
from creditlake.streaming.first_wins import read_first_wins, stream_first_wins

#: Rows arrive by id: those that are there already (even), the first load, the second.
_LOADS = (1, 3)


def _loads(df, key="id"):
    """The rows of each load, with the order of arrival."""
    return [df.where(F.col(key) % 4 == n).withColumn("seq", n * 10**12 + F.col(key)) for n in _LOADS]


_UPSERT = f"""WITH inc AS (SELECT (o_orderkey % 4) * 1000000000000 + o_orderkey AS seq, c_name || CASE (o_orderkey // 4) % 2 WHEN 0 THEN ' Limited' ELSE ' LTD' END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'I' || o_orderkey END AS isin,
  CASE WHEN o_orderkey % 5 = 0 THEN 'B' || o_orderkey END AS bse_code FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 1),
al AS (SELECT -1 AS seq, id, name, name_normalized, isin, NULL AS bse_code, is_listed FROM companies WHERE id % 2 = 0 UNION ALL SELECT seq, NULL, name, {sql_name('name')}, isin, bse_code, NULL FROM inc),
m AS (SELECT name_normalized, max(id) AS id, arg_min(name, seq) AS name, arg_max(isin, seq) FILTER (isin IS NOT NULL) AS isin, arg_max(bse_code, seq) FILTER (bse_code IS NOT NULL) AS bse_code,
  coalesce(arg_max(is_listed, seq) FILTER (is_listed IS NOT NULL), 0) AS is_listed, min(seq) AS first FROM al GROUP BY name_normalized)
SELECT name_normalized, coalesce(id, (SELECT max(id) FROM companies WHERE id % 2 = 0) + row_number() OVER (PARTITION BY id IS NULL ORDER BY first)) AS id, name, isin, bse_code, is_listed FROM m"""


@query("stored_companies", with_tables(_UPSERT, "companies"))
def _(spark, sf):
    table = I.stored_companies(scratch(spark), 8).create(A.companies(spark, sf).where("id % 2 = 0"))
    key = F.col("o_orderkey")
    o = A.read(spark, sf, "orders").join(A.read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    inc = o.select(key.alias("id"), F.concat("c_name", F.when(F.floor(key / 4) % 2 == 0, F.lit(" Limited")).otherwise(F.lit(" LTD"))).alias("name"), F.when(key % 3 == 0, F.concat(F.lit("I"), key.cast("string"))).alias("isin"), F.when(key % 5 == 0, F.concat(F.lit("B"), key.cast("string"))).alias("bse_code"))
    for load in _loads(inc):
        I.upsert_into(table, load.drop("id"))
    return table.read(spark).select("name_normalized", "id", "name", "isin", "bse_code", "is_listed")


#: Ratings after both loads: what was there, every row without a source_id, and the first of each other key.
_RATINGS = """SELECT * EXCLUDE (arrived, k) FROM (SELECT *, row_number() OVER (PARTITION BY company_id, agency, source_id, arrived > 0 AND source_id IS NOT NULL ORDER BY arrived, id) AS k,
    bool_or(arrived = 0) OVER (PARTITION BY company_id, agency, source_id) AS had FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 0 ELSE id % 4 END AS arrived FROM {0}))
  WHERE arrived = 0 OR source_id IS NULL OR (k = 1 AND NOT had)"""
_FINANCIALS = """SELECT * EXCLUDE (arrived, k) FROM (SELECT *, row_number() OVER (PARTITION BY company_id, fiscal_year, data_source ORDER BY coalesce(extraction_confidence, 0) DESC, arrived, id) AS k
    FROM (SELECT * REPLACE (CASE WHEN id % 11 <> 0 THEN fiscal_year END AS fiscal_year), CASE WHEN id % 2 = 0 THEN 0 ELSE id % 4 END AS arrived FROM {0})) WHERE fiscal_year IS NULL OR k = 1"""


@query("stored_ratings", with_tables(f"SELECT company_id, agency, source_id, rating_symbol, rating_date FROM ({_RATINGS.format('ratings')})", "ratings"))
def _(spark, sf):
    r = A.ratings(spark, sf)
    table = I.stored_ratings(scratch(spark), 8, 2).create(r.where("id % 2 = 0"))
    for load in _loads(r):
        I.insert_into(table, load.drop("id"))
    return table.read(spark).select("company_id", "agency", "source_id", "rating_symbol", "rating_date")


def _financials(spark, sf):
    return A.financials(spark, sf).withColumn("fiscal_year", F.when(F.col("id") % 11 != 0, F.col("fiscal_year")))


@query("stored_financials", with_tables(f"SELECT company_id, fiscal_year, data_source, revenue_cr, extraction_confidence FROM ({_FINANCIALS.format('financials')})", "financials"))
def _(spark, sf):
    f = _financials(spark, sf)
    table = I.stored_financials(scratch(spark), 8, 2).create(f.where("id % 2 = 0"))
    for load in _loads(f):
        I.merge_into(table, load.drop("id"))
    return table.read(spark).select("company_id", "fiscal_year", "data_source", "revenue_cr", "extraction_confidence")


_KEPT = with_tables(
    f"""WITH all_r AS ({CTES['ratings']}), ratings AS ({_RATINGS.format('all_r').replace('* EXCLUDE (arrived, k)', '* EXCLUDE (arrived, k, had)')}), all_f AS ({CTES['financials']}), financials AS ({_FINANCIALS.format('all_f')}),
latest_r AS ({CTES['latest_r']}), top_r AS ({CTES['top_r']}), latest_f AS ({CTES['latest_f']}), screened AS ({CTES['screened']})
SELECT * FROM screened WHERE company_id % 10 <> 3""",
    "companies",
)


@query("kept_screen", _KEPT)
def _(spark, sf):
    """The screen as it is kept through two loads and a deletion, each refreshed for its own companies; ids of ratings are kept, so ties go as in a full run."""
    c, r, f = A.companies(spark, sf), A.ratings(spark, sf), _financials(spark, sf)
    ratings, financials = I.stored_ratings(scratch(spark), 8, 2).create(r.where("id % 2 = 0")), I.stored_financials(scratch(spark), 8, 2).create(f.where("id % 2 = 0"))
    kept = I.stored_screen(scratch(spark), 8).create(S.screen(c, ratings.read(spark), financials.read(spark), None, order=False))
    for more_r, more_f in zip(_loads(r), _loads(f), strict=True):
        changed = I.insert_into(ratings, more_r).unionByName(I.merge_into(financials, more_f))
        I.refresh_screen(kept, c, ratings, financials, changed)
    gone = c.where("id % 10 = 3").select(F.col("id").alias("company_id"))
    for table in (ratings, financials):
        I.delete_from(table, gone)
    I.refresh_screen(kept, c.where("id % 10 <> 3"), ratings, financials, gone)
    return kept.read(spark)


@query("stream_first_wins", with_tables("SELECT company_id, agency, source_id, rating_symbol FROM (SELECT *, row_number() OVER (PARTITION BY company_id, agency, source_id ORDER BY id) AS k FROM ratings) WHERE source_id IS NULL OR k = 1", "ratings"))
def _(spark, sf):
    """Later ratings land first, earlier ones after a restart, with files that land again: the stream gives what a batch over all gives."""
    r = A.ratings(spark, sf).select(F.col("id").alias("seq"), "company_id", "agency", "source_id", "rating_symbol")
    schema, at = "seq long, company_id long, agency string, source_id string, rating_symbol string", scratch(spark)
    for n, some in enumerate(("seq % 3 = 2", "seq % 3 <> 1")):
        r.where(some).write.json(f"{at}/landed/{n}")
        stream_first_wins(spark, f"{at}/landed/*", schema, f"{at}/table", f"{at}/checkpoint").awaitTermination()
        r.where("seq % 3 = 1").write.mode("overwrite").json(f"{at}/landed/again")
    stream_first_wins(spark, f"{at}/landed/*", schema, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return read_first_wins(spark, schema, f"{at}/table").select("company_id", "agency", "source_id", "rating_symbol")


def _kept_loads(spark, sf):
    """Three loads by id, the second kept twice; their companies overlap."""
    c, r, f, at = A.companies(spark, sf), A.ratings(spark, sf), A.financials(spark, sf), scratch(spark)
    for n in (0, 1, 1, 2):
        N.keep_load(at, n, *(t.where(F.col("id") % 3 == n) for t in (c, r, f)))
    return at


@query("kept_summary_stats", with_tables("SELECT (SELECT count(*) FROM companies) AS companies, (SELECT count(DISTINCT company_id) FROM ratings) AS rated, (SELECT count(*) FROM ratings) AS ratings, (SELECT max(scraped_at) FROM ratings) AS last_scraped, (SELECT count(DISTINCT company_id) FROM financials) AS with_financials", "companies", "ratings", "financials"))
def _(spark, sf):
    return N.kept_summary(spark, _kept_loads(spark, sf))


@query("kept_financials_by_source", with_tables("SELECT data_source, count(*) AS n, count(DISTINCT company_id) AS companies FROM financials GROUP BY data_source", "financials"))
def _(spark, sf):
    return N.kept_by_source(spark, _kept_loads(spark, sf))
