"""Queries of the screen, reports and clean-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlake import dims
from creditlake.functions.names import is_state_owned, sector_group
from creditlake.functions.ratings import grade_band, grade_label, grade_preset
from creditlake.operators import reports, screen as S
from creditlake.plans import adapters as A
from creditlake.plans.adapters import with_tables
from creditlake.plans.registry import Query, QUERIES, query


def _screen(spark, sf, filters=S.Filters()):
    return S.screen(A.companies(spark, sf), A.ratings(spark, sf), A.financials(spark, sf), filters, order=False)


_OWNED = " OR ".join(f"contains(' ' || lower(\"Company Name\") || ' ', '{x}')" for x in dims.STATE_OWNED)
_GRADES = '"Grade" BETWEEN 1 AND 20'
_FILTERS = {
    "screen_default": (S.Filters(), _GRADES),
    "screen_grade": (S.Filters(max_grade=grade_preset("A- or better")[1]), '"Grade" BETWEEN 1 AND 7'),
    "screen_agency": (S.Filters(agencies=["CRISIL", "ICRA"]), f"{_GRADES} AND \"Agency\" IN ('CRISIL', 'ICRA')"),
    "screen_outlook": (S.Filters(outlooks=["Stable"]), f"{_GRADES} AND \"Outlook\" IN ('Stable')"),
    "screen_sector": (S.Filters(sectors=["Banks", "Power", "Textile"]), f"{_GRADES} AND \"Sector\" IN ('Banks', 'Power', 'Textile')"),
    "screen_listed": (S.Filters(listed_only=True, unlisted_only=True), f'{_GRADES} AND "Listed" = 1'),
    "screen_unlisted": (S.Filters(unlisted_only=True), f'{_GRADES} AND "Listed" = 0'),
    "screen_revenue": (S.Filters(min_revenue=20000, max_revenue=60000, min_ebitda=200), f'{_GRADES} AND "Revenue (Cr)" >= 20000 AND "Revenue (Cr)" <= 60000 AND "EBITDA (Cr)" >= 200'),
    "screen_leverage": (S.Filters(min_margin=10, max_leverage=8, min_debt=100), f'{_GRADES} AND "EBITDA Margin %" >= 10 AND "Net Debt/EBITDA" <= 8 AND "Total Debt (Cr)" >= 100'),
    "screen_sentinels": (S.Filters(min_margin=0, max_leverage=20, min_debt=0), _GRADES),
    "screen_not_state_owned": (S.Filters(drop_state_owned=True), f"{_GRADES} AND NOT ({_OWNED})"),
    "screen_name_search": (S.Filters(name_pattern="0[0-4]+ PRIVATE"), f"{_GRADES} AND regexp_matches(\"Company Name\", '0[0-4]+ PRIVATE', 'i')"),
}
for _name, (_f, _where) in _FILTERS.items():
    QUERIES[_name] = Query(lambda spark, sf, f=_f: _screen(spark, sf, f), with_tables(f"SELECT * FROM screened WHERE {_where}", "screened"))


@query("latest_rating", with_tables("SELECT id, company_id, agency, rating_date FROM latest_r", "latest_r"))
def _(spark, sf):
    return S.latest_rating(A.ratings(spark, sf)).select("id", "company_id", "agency", "rating_date")


@query("top_rating", with_tables("SELECT id, company_id, agency, rating_grade FROM top_r", "top_r"))
def _(spark, sf):
    return S.chosen(A.ratings(spark, sf)).select("id", "company_id", "agency", "rating_grade")


@query("latest_financials", with_tables("SELECT id, company_id, fiscal_year, revenue_cr FROM latest_f", "latest_f"))
def _(spark, sf):
    return S.latest_financials(A.financials(spark, sf)).select("id", "company_id", "fiscal_year", "revenue_cr")


@query("user_sort_top", with_tables(f'SELECT * FROM screened WHERE {_GRADES} ORDER BY "Net Debt/EBITDA" DESC NULLS LAST, "Company Name", company_id LIMIT 50', "screened"))
def _(spark, sf):
    return S.user_sort(_screen(spark, sf), "Net Debt/EBITDA", False, 50)


_LABEL = f"coalesce({A._list(dims.SYMBOLS)}[\"Grade\"], 'Grade ' || \"Grade\")"


@query("rating_distribution", with_tables(f"SELECT \"Grade\" AS grade, count(*) AS n, {_LABEL} AS symbol, {_LABEL} || ' (G' || \"Grade\" || ')' AS label FROM screened WHERE {_GRADES} GROUP BY \"Grade\"", "screened"))
def _(spark, sf):
    return S.rating_distribution(_screen(spark, sf))


_BANDS = "CASE " + " ".join(f"WHEN g BETWEEN {a} AND {b} THEN {n}" for n, (a, b) in enumerate(dims.BANDS, 1)) + " END"
_GROUP = "CASE " + " ".join(f"WHEN sector IN ({', '.join(repr(m) for m in members)}) THEN '{g}'" for g, members in dims.SECTOR_GROUPS.items() if g != "Corporate") + " ELSE 'Corporate' END"


@query("presentation", with_tables(f"SELECT id, CASE WHEN listed = 1 THEN 'Yes' ELSE 'No' END AS listed, {_GROUP} AS sector_group, coalesce({A._list(dims.SYMBOLS)}[g], 'Grade ' || g) AS grade_label, {_BANDS} AS band FROM (SELECT id, sector, id % 3 AS listed, CAST(id % 25 AS INTEGER) + 1 AS g FROM ratings)", "ratings"))
def _(spark, sf):
    r, g = A.ratings(spark, sf), (F.col("id") % 25 + 1).cast("int")
    return r.select("id", S.listed_label(F.col("id") % 3).alias("listed"), sector_group(F.col("sector")).alias("sector_group"), grade_label(g).alias("grade_label"), grade_band(g).alias("band"))


@query("grade_presets", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', (SELECT count(*) FROM orders WHERE o_orderkey % 23 BETWEEN {a} AND {b}))" for k, (a, b) in dims.PRESETS.items()) + ") t(preset, n)")
def _(spark, sf):
    r = A.ratings(spark, sf)
    counts = r.agg(*(F.count_if(F.col("rating_grade").between(*grade_preset(k))).alias(k) for k in dims.PRESETS))
    return counts.unpivot([], [F.col(f"`{k}`") for k in dims.PRESETS], "preset", "n")


@query("attach_notes", with_tables(f"SELECT s.* REPLACE (coalesce(\"Rationale URL\", '') AS \"Rationale URL\"), coalesce(n.note, '') AS \"Note\" FROM screened s LEFT JOIN notes n USING (company_id) WHERE {_GRADES}", "screened", "notes"))
def _(spark, sf):
    return S.attach_notes(_screen(spark, sf), A.notes(spark, sf))


@query("state_owned", with_tables(f"SELECT id, {_OWNED.replace(chr(34) + 'Company Name' + chr(34), 'name')} AS state_owned FROM companies", "companies"))
def _(spark, sf):
    return A.companies(spark, sf).select("id", is_state_owned(F.col("name")).alias("state_owned"))


@query("summary_stats", with_tables("SELECT (SELECT count(*) FROM companies) AS companies, (SELECT count(DISTINCT company_id) FROM ratings) AS rated, (SELECT count(*) FROM ratings) AS ratings, (SELECT max(scraped_at) FROM ratings) AS last_scraped, (SELECT count(DISTINCT company_id) FROM financials) AS with_financials", "companies", "ratings", "financials"))
def _(spark, sf):
    return reports.summary_stats(A.companies(spark, sf), A.ratings(spark, sf), A.financials(spark, sf))


@query("distinct_sectors", with_tables("SELECT DISTINCT sector FROM ratings WHERE sector <> ''", "ratings"))
def _(spark, sf):
    return reports.distinct_sectors(A.ratings(spark, sf))


@query("distinct_agencies", with_tables("SELECT DISTINCT agency FROM ratings WHERE agency IS NOT NULL", "ratings"))
def _(spark, sf):
    return reports.distinct_agencies(A.ratings(spark, sf))


@query("ratings_by_agency", with_tables("SELECT agency, count(*) AS n FROM ratings GROUP BY agency", "ratings"))
def _(spark, sf):
    return reports.ratings_by_agency(A.ratings(spark, sf))


@query("financials_by_source", with_tables("SELECT data_source, count(*) AS n, count(DISTINCT company_id) AS companies FROM financials GROUP BY data_source", "financials"))
def _(spark, sf):
    return reports.financials_by_source(A.financials(spark, sf))


@query("table_counts", with_tables("SELECT 'companies' AS table_name, count(*) AS n FROM companies UNION ALL SELECT 'ratings', count(*) FROM ratings UNION ALL SELECT 'financials', count(*) FROM financials UNION ALL SELECT 'notes', count(*) FROM notes", "companies", "ratings", "financials", "notes"))
def _(spark, sf):
    return reports.table_counts(companies=A.companies(spark, sf), ratings=A.ratings(spark, sf), financials=A.financials(spark, sf), notes=A.notes(spark, sf))


_KEY = "company_id, fiscal_year, data_source"


@query("duplicate_groups", with_tables(f"SELECT {_KEY}, count(*) AS n FROM financials GROUP BY {_KEY} HAVING count(*) > 1", "financials"))
def _(spark, sf):
    return reports.duplicate_groups(A.financials(spark, sf), reports.FINANCIAL_KEY)


@query("sectors_by_group", with_tables(f"SELECT sector_group, list_sort(list(sector)) AS sectors, count(*) AS n FROM (SELECT DISTINCT sector, {_GROUP} AS sector_group FROM ratings WHERE sector <> '') GROUP BY sector_group", "ratings"))
def _(spark, sf):
    return reports.sectors_by_group(A.ratings(spark, sf))


@query("orphan_ratings", with_tables("SELECT id, company_id FROM ratings WHERE company_id NOT IN (SELECT id FROM companies WHERE id % 9 <> 0)", "ratings", "companies"))
def _(spark, sf):
    return reports.orphans(A.ratings(spark, sf), A.companies(spark, sf).where("id % 9 <> 0")).select("id", "company_id")


@query("drop_duplicate_financials", with_tables(f"SELECT min(id) AS id FROM financials GROUP BY {_KEY}", "financials"))
def _(spark, sf):
    return reports.drop_duplicate_financials(A.financials(spark, sf)).select("id")


@query("drop_rating_shells", with_tables("SELECT id FROM ratings WHERE NOT (agency = 'CRISIL' AND source_id IS NULL AND rating_grade IS NULL)", "ratings"))
def _(spark, sf):
    return reports.drop_rating_shells(A.ratings(spark, sf)).select("id")


@query("drop_placeholders", with_tables("SELECT 'company' AS kind, id FROM companies WHERE id NOT IN (7, 26, 999999999) UNION ALL SELECT 'rating', id FROM ratings WHERE company_id NOT IN (7, 26)", "companies", "ratings"))
def _(spark, sf):
    c, r = reports.drop_placeholders(A.companies(spark, sf), A.ratings(spark, sf), [7, 26, 999999999])
    return c.select(F.lit("company").alias("kind"), "id").unionByName(r.select(F.lit("rating").alias("kind"), "id"))


_R, _F = "company_id % 6 <> 0", "company_id % 10 <> 0"
_USED = f"(SELECT {A.sql_moved(_R)} FROM ratings UNION SELECT {A.sql_moved(_F)} FROM financials)"


@query("drop_orphans", with_tables(f"SELECT 'company' AS kind, id FROM companies WHERE id IN {_USED} UNION ALL SELECT 'note', company_id FROM notes WHERE company_id IN {_USED}", "companies", "ratings", "financials", "notes"))
def _(spark, sf):
    c, n = reports.drop_orphans(A.companies(spark, sf), A.notes(spark, sf), A.moved(A.ratings(spark, sf), _R), A.moved(A.financials(spark, sf), _F))
    return c.select(F.lit("company").alias("kind"), "id").unionByName(n.select(F.lit("note").alias("kind"), F.col("company_id").alias("id")))


@query("check_unique", with_tables(f"SELECT count(*) AS duplicates FROM (SELECT 1 FROM financials GROUP BY {_KEY} HAVING count(*) > 1)", "financials"))
def _(spark, sf):
    return reports.duplicate_groups(A.financials(spark, sf), reports.FINANCIAL_KEY).agg(F.count(F.lit(1)).alias("duplicates"))


_CLEAN = f"""WITH fs AS (SELECT * REPLACE ({A.sql_moved(_F)} AS company_id) FROM financials), rs AS (SELECT * REPLACE ({A.sql_moved(_R)} AS company_id) FROM ratings),
f AS (SELECT company_id FROM fs GROUP BY {_KEY}), r AS (SELECT company_id FROM rs WHERE NOT (agency = 'CRISIL' AND source_id IS NULL AND rating_grade IS NULL) AND company_id NOT IN (60, 90)),
used AS (SELECT company_id FROM r UNION SELECT company_id FROM f), c AS (SELECT id FROM companies WHERE id NOT IN (60, 90) AND id IN (SELECT company_id FROM used)), n AS (SELECT company_id FROM notes WHERE company_id IN (SELECT company_id FROM used))
SELECT 'companies' AS table_name, (SELECT count(*) FROM companies) AS rows_before, (SELECT count(*) FROM c) AS rows_after UNION ALL SELECT 'ratings', (SELECT count(*) FROM ratings), (SELECT count(*) FROM r)
UNION ALL SELECT 'financials', (SELECT count(*) FROM financials), (SELECT count(*) FROM f) UNION ALL SELECT 'notes', (SELECT count(*) FROM notes), (SELECT count(*) FROM n)"""


@query("cleanup", with_tables(_CLEAN, "companies", "ratings", "financials", "notes"))
def _(spark, sf):
    return reports.cleanup(A.companies(spark, sf), A.moved(A.ratings(spark, sf), _R), A.moved(A.financials(spark, sf), _F), A.notes(spark, sf), [60, 90])[1]


@query("run_counts", with_tables("SELECT count(*) AS processed, count(*) FILTER (nm <> '' AND hit) AS matched, count(*) FILTER (nm <> '' AND NOT hit) AS not_found, count(*) FILTER (nm = '') AS errors FROM (SELECT CASE WHEN id % 7 = 0 THEN '' ELSE name END AS nm, id % 3 = 0 AS hit FROM companies)", "companies"))
def _(spark, sf):
    c = A.companies(spark, sf).withColumn("hit", F.col("id") % 3 == 0)
    return reports.run_counts(c, "hit", F.when(F.col("id") % 7 == 0, F.lit("  ")).otherwise(F.col("name")))
