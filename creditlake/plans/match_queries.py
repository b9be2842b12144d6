"""Queries of candidates, matching and incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlake.functions.names import normalize_name, normalize_name_ws, strip_suffix, strip_suffix_short
from creditlake.operators import match as J
from creditlake.plans import adapters as A
from creditlake.plans.adapters import sql_name, sql_name_ws, with_tables
from creditlake.plans.registry import query
from creditlake.streaming import ingest as R

#: Two companies in three have no financials here: their rows belong to ids that no company has.
_FEW = f"few AS (SELECT * REPLACE ({A.sql_moved('company_id % 3 <> 1')} AS company_id) FROM financials)"


def _tables(spark, sf):
    return A.companies(spark, sf), A.ratings(spark, sf), A.moved(A.financials(spark, sf), "company_id % 3 <> 1")


@query("pdf_candidates", with_tables(f"WITH {_FEW} SELECT DISTINCT c.id AS company_id, c.name, r.source_id, r.rating_grade FROM companies c JOIN ratings r ON c.id = r.company_id WHERE c.is_listed = 0 AND r.agency = 'ICRA' AND r.rating_grade <= 5 AND r.source_id <> '' AND c.id NOT IN (SELECT company_id FROM few)", "companies", "ratings", "financials"))
def _(spark, sf):
    return J.pdf_candidates(*_tables(spark, sf))


@query("html_candidates", with_tables(f"WITH {_FEW} SELECT DISTINCT c.id AS company_id, c.name, r.rating_grade, CASE r.sector WHEN 'Financial Sector' THEN 3 WHEN 'Infrastructure' THEN 2 ELSE 1 END AS turn FROM companies c JOIN ratings r ON c.id = r.company_id WHERE r.agency = 'CRISIL' AND c.id NOT IN (SELECT company_id FROM few)", "companies", "ratings", "financials"))
def _(spark, sf):
    return J.html_candidates(*_tables(spark, sf))


@query("unrated_candidates", with_tables(f"WITH {_FEW} SELECT id AS company_id, name FROM companies WHERE id NOT IN (SELECT company_id FROM few) AND id NOT IN (SELECT company_id FROM ratings WHERE agency = 'CARE Edge')", "companies", "ratings", "financials"))
def _(spark, sf):
    return J.unrated_candidates(*_tables(spark, sf), "CARE Edge")


@query("rated_without_financials", with_tables(f"WITH {_FEW} SELECT DISTINCT c.id AS company_id, c.name, r.rationale_url FROM companies c JOIN ratings r ON c.id = r.company_id WHERE r.agency = 'CARE Edge' AND r.rationale_url <> '' AND c.id NOT IN (SELECT company_id FROM few)", "companies", "ratings", "financials"))
def _(spark, sf):
    return J.rated_without_financials(*_tables(spark, sf), "CARE Edge")


@query("missing_companies", with_tables("SELECT (id * 2)::VARCHAR AS id FROM companies WHERE (id * 2)::VARCHAR NOT IN (SELECT regexp_extract(rationale_url, 'CompanyId=(\\d+)', 1) FROM ratings WHERE rationale_url IS NOT NULL)", "companies", "ratings"))
def _(spark, sf):
    c, r, _ = _tables(spark, sf)
    return J.missing_companies(c.select((F.col("id") * 2).cast("string").alias("id")), r)


@query("new_names", with_tables(f"SELECT DISTINCT name, {sql_name('name')} AS name_normalized FROM refs WHERE {sql_name('name')} NOT IN (SELECT name_normalized FROM companies)", "refs", "companies"))
def _(spark, sf):
    return J.new_names(A.references(spark, sf), A.companies(spark, sf))


_CASCADE = """WITH c AS (SELECT id AS company_id, isin, {ws} AS nn FROM companies), r AS (SELECT *, {ws} AS nn FROM refs),
bi AS (SELECT isin, arg_max(name, pos) AS name FROM r WHERE isin IS NOT NULL GROUP BY isin), bn AS (SELECT nn, arg_max(name, pos) AS name, arg_max(isin, pos) AS isin, arg_max(code, pos) AS code, min(pos) AS pos FROM r GROUP BY nn),
rest AS (SELECT company_id, nn FROM c WHERE (isin IS NULL OR isin NOT IN (SELECT isin FROM bi)) AND nn NOT IN (SELECT nn FROM bn)), held AS (SELECT company_id, arg_min(bn.name, bn.pos) AS name FROM rest JOIN bn ON contains(bn.nn, rest.nn[1:{n}]) GROUP BY company_id)
SELECT c.company_id, CASE WHEN bi.isin IS NOT NULL THEN 'isin' WHEN bn.nn IS NOT NULL THEN 'name' ELSE 'prefix' END AS rule, coalesce(bi.name, bn.name, held.name) AS ref_name
FROM c LEFT JOIN bi ON c.isin = bi.isin LEFT JOIN bn ON c.nn = bn.nn LEFT JOIN held ON c.company_id = held.company_id WHERE bi.isin IS NOT NULL OR bn.nn IS NOT NULL OR held.name IS NOT NULL"""

for _exchange, _n in (("bse", 20), ("nse", 25)):

    @query(f"match_listed_{_exchange}", with_tables(_CASCADE.format(n=_n, ws=sql_name_ws("name")), "companies", "refs"))
    def _(spark, sf, n=_n):
        return J.match_listed(A.companies(spark, sf), A.references(spark, sf), n).select("company_id", "rule", "ref_name")


@query("first_containing", with_tables(f"""WITH p AS (SELECT DISTINCT {sql_name_ws('name')}[1 + id % 3 : 1 + id % 3 + id % 23] AS prefix FROM companies), n AS (SELECT {sql_name_ws('name')} AS name_norm, pos FROM refs)
SELECT prefix, min(pos) AS pos FROM p JOIN n ON contains(name_norm, prefix) GROUP BY prefix""", "companies", "refs"))
def _(spark, sf):
    """Pieces of names of 1 to 23 characters, and the first reference that holds each."""
    name, k = normalize_name_ws(F.col("name")), F.col("id")
    pieces = A.companies(spark, sf).select(F.substring(name, (1 + k % 3).cast("int"), (1 + k % 23).cast("int")).alias("prefix"))
    return J.first_containing(pieces, A.references(spark, sf).select(name.alias("name_norm"), "pos"))


@query("match_index", with_tables("""WITH ix AS (SELECT pos, lower(name) AS key, CASE WHEN pos % 7 = 0 THEN '' ELSE 'f' || code END AS file FROM refs), co AS (SELECT id AS company_id, lower(c_name) || CASE WHEN id % 5 = 0 THEN ' limited' ELSE '' END AS key FROM companies JOIN customer ON id = c_custkey),
held AS (SELECT co.company_id, arg_min(ix.file, ix.pos) AS file FROM co JOIN ix ON contains(ix.key, co.key[1:30]) GROUP BY co.company_id)
SELECT co.company_id, CASE WHEN ix.key IS NOT NULL THEN ix.file ELSE held.file END AS file FROM co LEFT JOIN ix ON co.key = ix.key LEFT JOIN held ON co.company_id = held.company_id WHERE CASE WHEN ix.key IS NOT NULL THEN ix.file ELSE held.file END <> ''""", "refs", "companies"))
def _(spark, sf):
    r = A.references(spark, sf).select("pos", F.lower("name").alias("key"), F.when(F.col("pos") % 7 == 0, "").otherwise(F.concat(F.lit("f"), "code")).alias("file"))
    c = A.read(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.concat(F.lower("c_name"), F.when(F.col("c_custkey") % 5 == 0, F.lit(" limited")).otherwise(F.lit(""))).alias("key"))
    return J.match_index(c, r)


@query("match_search", with_tables(f"""WITH s AS (SELECT id AS company_id, unnest([1, 2, 3]) AS pos, unnest(['Other ' || name, name || ' India', name]) AS name FROM companies), m AS (SELECT s.company_id, s.pos, s.name, {sql_name_ws('s.name')} AS got, {sql_name_ws('c.name')} AS own FROM s JOIN companies c ON s.company_id = c.id)
SELECT company_id, arg_min(name, pos) AS result FROM m WHERE got = own OR (least(length(got), length(own)) >= 10 AND (starts_with(got, own) OR starts_with(own, got))) GROUP BY company_id""", "companies"))
def _(spark, sf):
    c = A.companies(spark, sf)
    names = F.array(F.concat(F.lit("Other "), "name"), F.concat("name", F.lit(" India")), F.col("name"))
    return J.match_search(c.select(F.col("id").alias("company_id"), F.posexplode(names).alias("pos", "name")), c)


_SHORT = r"trim(regexp_replace(regexp_replace(lower(name), '\b(limited|ltd|private|pvt|llp)\b', '', 'g'), '\s+', ' ', 'g'))"
_LONG = r"trim(regexp_replace(lower(regexp_replace(name, '\b(limited|ltd|private|pvt|llp|llc|co\.?|corp\.?|inc\.?|plc)\b\.?', '', 'gi')), '\s+', ' ', 'g'))"


@query("index_file_lookup", with_tables(f"WITH x AS (SELECT {_LONG} AS key, min(code) AS file FROM refs GROUP BY 1) SELECT c.id, x.file FROM (SELECT id, {_SHORT} AS key FROM companies) c LEFT JOIN x USING (key)", "refs", "companies"))
def _(spark, sf):
    x = A.references(spark, sf).groupBy(strip_suffix(F.col("name")).alias("key")).agg(F.min("code").alias("file"))
    return J.index_file_lookup(A.companies(spark, sf).select("id", strip_suffix_short(F.col("name")).alias("key")), x).select("id", "file")


@query("latest_press_release", "SELECT company_id, pos FROM (SELECT user_id AS company_id, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 4 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') END DESC, event_id) AS k FROM events) WHERE k = 1")
def _(spark, sf):
    e = A.read(spark, sf, "events").select(F.col("user_id").alias("company_id"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("published"))
    return J.latest_press_release(e).select("company_id", "pos")


@query("last_wins", "SELECT event_type AS key, arg_max(user_id, event_id) AS user_id, min(event_id) AS pos FROM events GROUP BY event_type")
def _(spark, sf):
    e = A.read(spark, sf, "events").select(F.col("event_type").alias("key"), "user_id", F.col("event_id").alias("pos"))
    return J.last_wins(e, "key", ["user_id"])


_DOCS = "SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey AS pos, c_name || CASE o_orderkey % 2 WHEN 0 THEN ' Ltd' ELSE ' Corp' END AS name, 'f' || o_orderkey AS file FROM orders JOIN customer ON o_custkey = c_custkey"


@query("build_name_index", f"WITH docs AS (SELECT *, {_LONG} AS key FROM ({_DOCS})), ex AS (SELECT lower(c_name) AS key, c_name AS name, 'old' AS file FROM customer WHERE c_custkey % 4 = 0) SELECT * FROM ex UNION ALL SELECT key, arg_min(name, (d, pos)), arg_min(file, (d, pos)) FROM docs WHERE d > DATE '1996-06-01' AND key NOT IN (SELECT key FROM ex) GROUP BY key")
def _(spark, sf):
    key, c = F.col("o_orderkey"), A.read(spark, sf, "customer")
    d = A.read(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.to_date("o_orderdate").alias("chunk_date"), key.alias("pos"), F.concat("c_name", F.when(key % 2 == 0, F.lit(" Ltd")).otherwise(F.lit(" Corp"))).alias("name"), F.concat(F.lit("f"), key.cast("string")).alias("file"))
    return R.build_name_index(d, c.where("c_custkey % 4 = 0").select(F.lower("c_name").alias("key"), F.col("c_name").alias("name"), F.lit("old").alias("file")), "1996-06-01")


@query("date_chunks", "WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 80 AS INTEGER) AS b FROM orders), x AS (SELECT id, b, unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS d FROM o) SELECT id, strftime(d, '%m/%d/%Y') AS first, strftime(least(last_day(CAST(d AS DATE)), b), '%m/%d/%Y') AS last FROM x")
def _(spark, sf):
    o = A.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("a"))
    o = o.withColumn("b", F.date_add("a", (F.col("id") % 80).cast("int")))
    return o.select("id", F.explode(R.date_chunks(F.col("a"), F.col("b"), True)).alias("x")).select("id", "x.*")


@query("date_chunks_daily", "WITH o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) AS b FROM orders), x AS (SELECT id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM o) SELECT id, strftime(d, '%m/%d/%Y') AS first, strftime(d, '%m/%d/%Y') AS last FROM x")
def _(spark, sf):
    o = A.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("a"))
    return o.select("id", F.explode(R.date_chunks(F.col("a"), F.date_add("a", (F.col("id") % 4).cast("int")), False)).alias("x")).select("id", "x.*")


@query("after_checkpoint", "SELECT event_id::VARCHAR AS id FROM events WHERE event_id > 500 AND event_id <= 1500")
def _(spark, sf):
    return R.after_checkpoint(A.read(spark, sf, "events").select(F.col("event_id").cast("string").alias("id")), "id", 500, 1500)


@query("next_checkpoint", "SELECT max(event_id) AS checkpoint FROM events")
def _(spark, sf):
    done = A.read(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"))
    return spark.range(1).select(F.lit(R.next_checkpoint(done, "id", 500)).cast("long").alias("checkpoint"))


@query("prefix_buckets", "SELECT prefix, count(*) AS n FROM (SELECT regexp_extract(lower(p_name), '^([a-z]{2})', 1) AS prefix FROM part) GROUP BY prefix")
def _(spark, sf):
    return A.read(spark, sf, "part").groupBy(R.prefix_bucket(F.col("p_name")).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


@query("name_keys", with_tables(f"SELECT id, {sql_name('name')} AS key, {sql_name_ws('name')} AS key_ws, {_LONG} AS index_key, {_SHORT} AS lookup_key FROM (SELECT pos AS id, '  ' || name || '   Co.  ' AS name FROM refs)", "refs"))
def _(spark, sf):
    name = F.concat(F.lit("  "), "name", F.lit("   Co.  "))
    return A.references(spark, sf).select(F.col("pos").alias("id"), normalize_name(name).alias("key"), normalize_name_ws(name).alias("key_ws"), strip_suffix(name).alias("index_key"), strip_suffix_short(name).alias("lookup_key"))


@query("run_pipeline", with_tables(f"WITH {_FEW}, left_over AS (SELECT id FROM companies WHERE id NOT IN (SELECT company_id FROM few)) SELECT 'match' AS step, (SELECT count(*) FROM left_over) AS n UNION ALL SELECT 'report', (SELECT count(DISTINCT agency) FROM ratings)", "companies", "ratings", "financials"))
def _(spark, sf):
    """Chosen steps in their order, each over whole tables: what the first left is what the second could not undo."""
    c, r, f = _tables(spark, sf)
    steps = [("load", lambda: r.limit(0)), ("match", lambda: c.select(F.col("id").alias("company_id")).join(f.select("company_id"), "company_id", "left_anti")), ("report", lambda: r.select("agency").distinct())]
    done = R.run_pipeline(steps, {"report", "match"})
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("step"), "n") for name, df in done.items()]
    return counts[0].unionByName(counts[1])
