"""The driver's tables shaped as companies, ratings and financials, for queries and for their SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake import dims
from creditlake.functions.names import normalize_name

AGENCIES = ["ICRA", "CRISIL", "CARE Edge", "India Ratings", "Acuite"]
PREFIXES = ["[ICRA]", "CRISIL ", "CARE ", "IND ", "ACUITE "]
SECTORS = ["Banks", "Power", "Financial Sector", "Infrastructure", "Textile", "", None]
SUFFIXES = [" Limited", " Private Limited", " ntpc Ltd", " LLP"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pick(values: list, n):
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), n.cast("int"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    name = F.concat("c_name", _pick(SUFFIXES, key % 4))
    return c.select(
        key.alias("id"), name.alias("name"), normalize_name(name).alias("name_normalized"), F.lit(None).cast("string").alias("cin"),
        F.when(key % 3 == 0, F.concat(F.lit("INE"), F.lpad(key.cast("string"), 9, "0"))).alias("isin"), F.lit(None).cast("string").alias("bse_code"),
        F.lit(None).cast("string").alias("nse_symbol"), (key % 2).cast("int").alias("is_listed"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    place = (F.ascii("o_orderpriority") - 49) % 5
    grade = F.when((key % 23).between(1, 20), (key % 23).cast("int"))
    symbol = F.when(grade.isNotNull(), F.concat(_pick(PREFIXES, place), _pick(["", *dims.SYMBOLS], grade)))
    outlook = F.when(F.col("o_orderstatus") == "F", "Stable").when(F.col("o_orderstatus") == "O", "Positive").otherwise("Negative")
    return o.select(
        key.alias("id"), cust.alias("company_id"), _pick(AGENCIES, place).alias("agency"), symbol.alias("rating_symbol"), grade.alias("rating_grade"), outlook.alias("outlook"),
        F.when(key % 17 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("rating_date"), _pick(SECTORS, cust % 7).alias("sector"),
        F.when(key % 5 != 0, (key % 400).cast("string")).alias("source_id"), F.when(key % 11 != 0, F.concat(F.lit("https://x/?CompanyId="), cust.cast("string"))).alias("rationale_url"),
        F.col("o_orderdate").alias("scraped_at"),
    )


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")))
    l = l.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ident = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return l.select(
        ident.alias("id"), F.col("o_custkey").alias("company_id"), F.year("l_shipdate").alias("fiscal_year"), F.col("l_extendedprice").alias("revenue_cr"),
        F.when(ident % 7 != 0, F.col("l_quantity") * 20).alias("ebitda_cr"), F.when(ident % 5 != 0, F.floor(F.col("l_quantity") * 3).cast("double")).alias("ebitda_margin_pct"),
        (F.floor(F.col("l_tax") * 1000).cast("double")).alias("pat_cr"), (F.col("l_quantity") * 25).alias("total_debt_cr"), F.floor(F.col("l_discount") * 1000).cast("double").alias("cash_cr"),
        F.when(ident % 3 != 0, F.col("l_quantity") * 22).alias("net_debt_cr"), F.when(ident % 4 == 0, F.col("l_quantity")).alias("capex_cr"),
        F.when(ident % 6 != 0, F.floor(F.col("l_quantity") / 4).cast("double")).alias("net_debt_ebitda"), F.concat(F.lit("src_"), F.col("l_returnflag")).alias("data_source"),
        F.when(ident % 13 != 0, F.floor(F.col("l_discount") * 100).cast("double") / 10).alias("extraction_confidence"),
    )


NOBODY = 100_000_000  #: added to a company's id gives one that no company has


def moved(df: DataFrame, condition: str) -> DataFrame:
    """All rows; those of the condition belong to a company that isn't there."""
    return df.withColumn("company_id", F.when(F.expr(condition), F.col("company_id") + NOBODY).otherwise(F.col("company_id")))


def sql_moved(condition: str) -> str:
    return f"CASE WHEN {condition} THEN company_id + {NOBODY} ELSE company_id END"


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").where(F.col("c_custkey") % 4 == 0)
    return c.select(F.col("c_custkey").alias("company_id"), F.concat(F.lit("note on "), F.col("c_mktsegment")).alias("note"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, name, isin, code: names of customers again, some longer, some under another name, and suppliers."""
    key = F.col("c_custkey")
    c = read(spark, sf_dir, "customer").where(key % 5 < 3)
    tail = F.when(key % 5 == 0, F.lit(" Limited")).when(key % 5 == 1, F.lit(" ltd India")).otherwise(F.lit(" Holdings Pvt"))
    own = c.select(key.alias("pos"), F.concat("c_name", tail).alias("name"), F.when(key % 6 == 0, F.concat(F.lit("INE"), F.lpad(key.cast("string"), 9, "0"))).alias("isin"), key.cast("string").alias("code"))
    s = read(spark, sf_dir, "supplier")
    return own.unionByName(s.select((F.col("s_suppkey") + 10_000_000).alias("pos"), F.concat("s_name", F.lit(" Limited")).alias("name"), F.lit(None).cast("string").alias("isin"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code")))


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def sql_name(c: str) -> str:
    return f"replace(replace(replace(trim(lower({c})), 'limited', 'ltd'), 'private', 'pvt'), '  ', ' ')"


def sql_name_ws(c: str) -> str:
    return f"regexp_replace(replace(replace(trim(lower({c})), 'limited', 'ltd'), 'private', 'pvt'), '\\s+', ' ', 'g')"


CTES = {
    "companies": f"""SELECT c_custkey AS id, c_name || {_list(SUFFIXES)}[c_custkey % 4 + 1] AS name, {sql_name(f"c_name || {_list(SUFFIXES)}[c_custkey % 4 + 1]")} AS name_normalized,
  CASE WHEN c_custkey % 3 = 0 THEN 'INE' || lpad(c_custkey::VARCHAR, 9, '0') END AS isin, CAST(c_custkey % 2 AS INTEGER) AS is_listed FROM customer""",
    "ratings": f"""SELECT o_orderkey AS id, o_custkey AS company_id, {_list(AGENCIES)}[place + 1] AS agency, CASE WHEN g BETWEEN 1 AND 20 THEN {_list(PREFIXES)}[place + 1] || {_list(dims.SYMBOLS)}[g] END AS rating_symbol,
  CASE WHEN g BETWEEN 1 AND 20 THEN g END AS rating_grade, CASE o_orderstatus WHEN 'F' THEN 'Stable' WHEN 'O' THEN 'Positive' ELSE 'Negative' END AS outlook,
  CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS rating_date, {_list(SECTORS)}[o_custkey % 7 + 1] AS sector,
  CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 400)::VARCHAR END AS source_id, CASE WHEN o_orderkey % 11 <> 0 THEN 'https://x/?CompanyId=' || o_custkey::VARCHAR END AS rationale_url, o_orderdate AS scraped_at
  FROM (SELECT *, (ascii(o_orderpriority) - 49) % 5 AS place, CAST(o_orderkey % 23 AS INTEGER) AS g FROM orders)""",
    "financials": """SELECT ident AS id, o_custkey AS company_id, CAST(year(ship) AS INTEGER) AS fiscal_year, price AS revenue_cr, CASE WHEN ident % 7 <> 0 THEN q * 20 END AS ebitda_cr,
  CASE WHEN ident % 5 <> 0 THEN floor(q * 3) END AS ebitda_margin_pct, floor(tax * 1000) AS pat_cr, q * 25 AS total_debt_cr, floor(disc * 1000) AS cash_cr, CASE WHEN ident % 3 <> 0 THEN q * 22 END AS net_debt_cr,
  CASE WHEN ident % 4 = 0 THEN q END AS capex_cr, CASE WHEN ident % 6 <> 0 THEN floor(q / 4) END AS net_debt_ebitda, 'src_' || flag AS data_source, CASE WHEN ident % 13 <> 0 THEN floor(disc * 100) / 10 END AS extraction_confidence
  FROM (SELECT l_orderkey, l_orderkey * 100 + l_linenumber AS ident, max(l_quantity) AS q, max(l_extendedprice) AS price, max(l_discount) AS disc, max(l_tax) AS tax, max(l_returnflag) AS flag, max(l_shipdate) AS ship
    FROM lineitem GROUP BY l_orderkey, l_linenumber) JOIN orders ON l_orderkey = o_orderkey""",
    "notes": "SELECT c_custkey AS company_id, 'note on ' || c_mktsegment AS note FROM customer WHERE c_custkey % 4 = 0",
    "refs": """SELECT c_custkey AS pos, c_name || CASE c_custkey % 5 WHEN 0 THEN ' Limited' WHEN 1 THEN ' ltd India' ELSE ' Holdings Pvt' END AS name,
  CASE WHEN c_custkey % 6 = 0 THEN 'INE' || lpad(c_custkey::VARCHAR, 9, '0') END AS isin, c_custkey::VARCHAR AS code FROM customer WHERE c_custkey % 5 < 3
  UNION ALL SELECT s_suppkey + 10000000, s_name || ' Limited', NULL, 'S' || s_suppkey::VARCHAR FROM supplier""",
}
_LATEST = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY company_id, agency ORDER BY rating_date DESC NULLS LAST, id DESC) AS k FROM ratings) WHERE k = 1"
_TOP = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY rating_grade NULLS LAST, rating_date DESC NULLS LAST, agency, id DESC) AS k FROM latest_r) WHERE k = 1"
_NEWEST = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC NULLS LAST, id DESC) AS k FROM financials) WHERE k = 1"
CTES |= {"latest_r": _LATEST, "top_r": _TOP, "latest_f": _NEWEST}
CTES["screened"] = """SELECT c.id AS company_id, c.name AS "Company Name", r.agency AS "Agency", r.rating_symbol AS "Rating", r.rating_grade AS "Grade", r.outlook AS "Outlook", r.sector AS "Sector", c.is_listed AS "Listed",
  f.revenue_cr AS "Revenue (Cr)", f.ebitda_cr AS "EBITDA (Cr)", f.ebitda_margin_pct AS "EBITDA Margin %", f.total_debt_cr AS "Total Debt (Cr)", f.net_debt_cr AS "Net Debt (Cr)", f.net_debt_ebitda AS "Net Debt/EBITDA",
  r.rating_date AS "Rating Date", r.rationale_url AS "Rationale URL", NULL::VARCHAR AS "BSE Code", c.isin AS "ISIN"
  FROM companies c JOIN top_r r ON c.id = r.company_id LEFT JOIN latest_f f ON c.id = f.company_id"""
_NEEDS = {"latest_r": ["ratings"], "top_r": ["latest_r"], "latest_f": ["financials"], "screened": ["companies", "top_r", "latest_f"]}


def with_tables(query: str, *names: str) -> str:
    """The query after WITH clauses for these tables and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    body = query.strip()
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
