"""Queries of readers and writers, over texts made from the driver's pages, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlake.operators import financials as X
from creditlake.operators import screen as S
from creditlake.plans import adapters as A
from creditlake.plans.adapters import with_tables
from creditlake.plans.registry import query
from creditlake.sources import html as H
from creditlake.sources import readers as R
from creditlake.sources import writers as W
from creditlake.sources.arrays import read_elements
from creditlake.sources.writers import scratch


def landed(answers, files: bool) -> str:
    """Answers (value) as landed: a file each, or a line each."""
    to = scratch(answers.sparkSession)
    (answers.write.option("maxRecordsPerFile", 1) if files else answers.write).text(to)
    return to


def _listing(spark, sf):
    k = F.col("page_id").cast("string")
    script = F.concat(F.lit('<script>var RatingBaseModel = [{"CompanyName": "Firm '), k, F.lit('", "rating": "[ICRA]AA+ (Stable)", "Amount": "1,'), k, F.lit('0 Cr", "RatId": '), k, F.lit('}, {"company": "", "Rating": "ICRA D"}];\n</script>'))
    return A.read(spark, sf, "pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), script).alias("html"))


@query("embedded_array", "SELECT page_id, 0 AS pos, 'Firm ' || page_id AS company_name, 2 AS rating_grade, 'Stable' AS outlook, page_id::VARCHAR AS rationale_id, CAST('1' || page_id || '0' AS DOUBLE) AS rated_amount_cr FROM pages UNION ALL SELECT page_id, 1, '', 20, '', NULL, NULL FROM pages")
def _(spark, sf):
    r = R.parse_listing_record(R.read_embedded_array(_listing(spark, sf)))
    return r.select("page_id", "pos", "company_name", "rating_grade", "outlook", "rationale_id", "rated_amount_cr")


@query("embedded_detail", "SELECT page_id AS company_id, 'CARE BBB Negative' AS raw_rating, 9 AS rating_grade, 'Loan / Bank' AS instrument, '2025-03-31' AS rating_date, CAST(nullif(page_id % 5, 0) AS DOUBLE) AS rated_amount_cr, page_id || '_0' AS source_id FROM pages UNION ALL SELECT page_id, 'D', 20, '', NULL, NULL, page_id || '_1' FROM pages")
def _(spark, sf):
    k = F.col("page_id").cast("string")
    script = F.concat(F.lit('var RatingDetails = {"LstRatingInstrumentData": [{"Long": "CARE BBB", "LongOutlook": "Negative", "Instrument1": "Loan", "Instrument3": "Bank", "RatingDate": "2025-03-31T00:00:00+05:30", "RatingAmount": "'), (F.col("page_id") % 5).cast("string"), F.lit('"}, {"Long": "none"}, {"Long": "D"}]};\n'))
    pages = A.read(spark, sf, "pages").select(F.col("page_id").alias("company_id"), F.concat(F.coalesce("html", F.lit("")), script, k).alias("html"))
    return R.parse_detail_records(R.read_embedded_detail(pages)).select("company_id", "raw_rating", "rating_grade", "instrument", "rating_date", "rated_amount_cr", "source_id")


@query("company_universe", "SELECT id, arg_max(name, event_id) AS name FROM (SELECT event_id, user_id::VARCHAR AS id, 'Firm ' || event_id AS name FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, (user_id + 1000000)::VARCHAR, 'Other ' || event_id FROM events) GROUP BY id")
def _(spark, sf):
    e, u = F.col("event_id").cast("string"), F.col("user_id")
    first = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" Firm "), e)).otherwise(F.lit(" "))
    return R.read_company_universe(A.read(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(u.cast("string"), F.lit("# "), (u + 1000000).cast("string"), F.lit("#x")).alias("id"), F.concat(first, F.lit("#Other "), e, F.lit("#No")).alias("label")))


@query("issuer_ratings", "SELECT o_orderkey AS issuer_id, 0 AS idx, 'AA' AS rating_symbol, 3 AS rating_grade, 'Stable' AS outlook, 'LT' AS instrument_type, CAST('1' || o_custkey AS DOUBLE) AS rated_amount_cr, o_orderkey || '_0' AS source_id FROM orders UNION ALL SELECT o_orderkey, 1, 'IND A1+', NULL, '', 'ST', NULL, o_orderkey || '_1' FROM orders")
def _(spark, sf):
    o = A.read(spark, sf, "orders")
    two = F.array(F.struct(F.lit("IND AA / Stable").alias("rating"), F.lit("Loan").alias("instrumentName"), F.concat(F.lit(" 1,"), F.col("o_custkey").cast("string")).alias("amount")), F.struct(F.lit("IND A1+").alias("rating"), F.lit("Loan").alias("instrumentName"), F.lit(None).cast("string").alias("amount")))
    i = o.select(F.col("o_orderkey").alias("issuer_id"), F.lit("n").alias("name"), F.lit("s").alias("sector"), F.lit("t").alias("subSector"), F.lit("d").alias("effectiveDate"), two.alias("ratingsList"))
    return R.parse_issuer_ratings(i).select("issuer_id", "idx", "rating_symbol", "rating_grade", "outlook", "instrument_type", "rated_amount_cr", "source_id")


@query("scrips", "SELECT c_custkey AS pos, c_custkey::VARCHAR AS code, 'SYM' || c_custkey AS symbol, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'INE' || c_custkey ELSE '' END AS isin FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    s = k.cast("string")
    rec = F.create_map(F.lit("SCRIP_CD"), F.when(k % 2 == 0, s), F.lit("scripCd"), s, F.lit("SCRIP_ID"), F.concat(F.lit(" SYM"), s), F.lit("SCRIP_NAME"), F.col("c_name"), F.lit("ISIN"), F.when(k % 2 == 0, F.concat(F.lit("INE"), s)).otherwise(F.lit("")))
    return R.scrip_columns(A.read(spark, sf, "customer").select(k.alias("pos"), rec.alias("rec")))


@query("notes_json", "SELECT c_custkey AS company_id, c_mktsegment AS note FROM customer WHERE c_custkey % 2 = 0")
def _(spark, sf):
    k = F.col("c_custkey")
    c = A.read(spark, sf, "customer").select(F.to_json(F.create_map(k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(F.lit(" ")))).alias("value"))
    return R.parse_notes(c)


#: Headings as pages have them: in one piece, split over spans, far from their table, and before tables with stray and left-out end tags.
_HEADS = ["<p>Key <b>Financial</b> Indicators</p><table>", "<p><span>Key Financial Indic</span><span>ators</span></p><table>", "<div>Key  Financial\nIndicators</div><p>FAR</p><table>", "<h3>KEY FINANCIAL INDICATORS</h3></b><table></i>"]


def _kfi_html(spark, sf):
    k = F.col("page_id")
    head = F.replace(F.get(F.array(*map(F.lit, _HEADS)), (k % 4).cast("int")), F.lit("FAR"), F.repeat(F.lit("word "), 200))
    shut = lambda tag: F.when(k % 4 == 3, F.lit("")).otherwise(F.lit(f"</{tag}>"))
    cells = (("As on", "Unit", "FY 2024", "Mar-23"), ("Operating income", "Rs.Crore", (k % 90 + 1).cast("string"), "(5.2)"), ("PAT margins", "%", "-3.5", "--"))
    rows = [F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.lit(c) if isinstance(c, str) else c, shut("td")) for c in row), shut("tr")) for row in cells]
    return A.read(spark, sf, "pages").select(k.alias("doc_id"), F.concat(F.coalesce("html", F.lit("")), head, *rows, F.lit("</table><ul><li>Criteria for rating hotels</li></ul>")).alias("html"))


@query("key_indicators", "SELECT page_id AS doc_id, 2024 AS fiscal_year, CAST(page_id % 90 + 1 AS DOUBLE) AS revenue_cr, 3.5::DOUBLE AS ebitda_margin_pct FROM pages UNION ALL SELECT page_id, 2023, -5.2, NULL FROM pages")
def _(spark, sf):
    return X.parse_kfi(H.html_cells(_kfi_html(spark, sf))).select("doc_id", "fiscal_year", "revenue_cr", "ebitda_margin_pct")


@query("criteria_of_pages", "SELECT page_id AS doc_id, 'Hotels' AS sector FROM pages")
def _(spark, sf):
    from creditlake.functions.names import sector_from_criteria

    return H.criteria_text(_kfi_html(spark, sf)).select("doc_id", sector_from_criteria(F.col("criteria")).alias("sector"))


def _by_nation(spark, sf, *record):
    """c_nationkey, records: a list of one struct a customer for each nation, in order."""
    return A.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct("c_custkey", F.struct(*record).alias("r")))).alias("x")).select("c_nationkey", F.col("x.r").alias("records"))


@query("suggest_files", "SELECT c_name || ':' || c_mktsegment AS value FROM customer WHERE c_custkey % 3 <> 0")
def _(spark, sf):
    value = F.when(F.col("c_custkey") % 3 != 0, F.concat("c_name", F.lit(":"), "c_mktsegment")).otherwise(F.lit(""))
    return R.read_suggest(spark, landed(_by_nation(spark, sf, value.alias("value")).select(F.to_json("records").alias("value")), True))


@query("listing_lines", "SELECT c_name AS companyName, 'C' || c_custkey AS companyCode, 'f' || c_custkey || '.html' AS ratingFileName, c_mktsegment AS ratingDate, c_nationkey::VARCHAR AS prId FROM customer WHERE c_custkey % 5 <> 0")
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    file = F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("f"), k, F.lit(".html"))).otherwise(F.lit(""))
    docs = _by_nation(spark, sf, F.col("c_name").alias("companyName"), F.concat(F.lit("C"), k).alias("companyCode"), file.alias("ratingFileName"), F.col("c_mktsegment").alias("ratingDate"), F.col("c_nationkey").cast("string").alias("prId"))
    return R.read_listing_docs(spark, landed(docs.select(F.to_json(F.struct(F.col("records").alias("docs"))).alias("value")), False), True)


@query("issuer_lines", "SELECT c_custkey AS issuer_id, c_name AS name, c_mktsegment AS sector, 'IND A / Stable' AS rating, (c_custkey % 900)::VARCHAR AS amount FROM customer WHERE c_custkey % 7 <> 0")
def _(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 7 != 0, F.col("c_name")).otherwise(F.lit("  "))
    one = F.struct(k.alias("issuer_id"), name.alias("name"), F.col("c_mktsegment").alias("sector"), F.array(F.struct(F.lit("IND A / Stable").alias("rating"), (k % 900).cast("string").alias("amount"))).alias("ratingsList"))
    c = A.read(spark, sf, "customer").select(F.when(k % 2 == 0, F.to_json(one)).otherwise(F.to_json(F.array(one, one))).alias("value"))
    r = F.col("ratingsList")[0]
    return R.read_issuers(spark, landed(c, False), True).select("issuer_id", "name", "sector", r["rating"].alias("rating"), r["amount"].alias("amount"))


@query("press_release_files", "SELECT c_name AS company, 'https://x/' || c_custkey AS file_url, 'T' || c_custkey AS title, c_mktsegment AS published, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer")
def _(spark, sf):
    k = F.col("c_custkey").cast("string")
    n = _by_nation(spark, sf, F.col("c_name").alias("CompanyName"), F.concat(F.lit("https://x/"), k).alias("FileURL"), F.concat(F.lit("T"), k).alias("FileTitle"), F.col("c_mktsegment").alias("PublishedDate"))
    wrapped = F.to_json(F.struct(F.col("records").alias("data")))
    return R.read_press_releases(spark, landed(n.select(F.when(F.col("c_nationkey") % 2 == 0, wrapped).otherwise(F.to_json("records")).alias("value")), True))


@query("scrip_lines", "SELECT 0 AS pos, c_custkey::VARCHAR AS code, 'S' || c_custkey AS symbol, c_name AS name, '' AS isin FROM customer")
def _(spark, sf):
    rec = F.create_map(F.lit("ScripCd"), F.col("c_custkey").cast("string"), F.lit("symbol"), F.concat(F.lit(" S"), F.col("c_custkey").cast("string")), F.lit("ScripName"), F.col("c_name"))
    wrapped = F.get(F.array(*(F.to_json(F.create_map(F.lit(w), F.array(rec))) for w in R.SCRIP_WRAPPERS)), (F.col("c_custkey") % len(R.SCRIP_WRAPPERS)).cast("int"))
    return R.read_scrips(spark, landed(A.read(spark, sf, "customer").select(wrapped.alias("value")), False), True)


@query("result_lines", "SELECT 0 AS pos, o_totalprice::VARCHAR AS pbt, 'A' AS kind FROM orders")
def _(spark, sf):
    rec = F.create_map(F.lit("PBT"), F.col("o_totalprice").cast("string"), F.lit("PeriodType"), F.lit("A"))
    line = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.create_map(F.lit("Results"), F.array(rec)))).otherwise(F.to_json(F.array(rec)))
    return R.read_results(spark, landed(A.read(spark, sf, "orders").select(line.alias("value")), False), True).select("pos", F.col("rec")["PBT"].alias("pbt"), F.col("rec")["PeriodType"].alias("kind"))


@query("array_elements", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM documents")
def _(spark, sf):
    """Whole documents, quotes, brackets and all, in lists of five hundred a file, read by ranges that cut them anywhere."""
    d = A.read(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 500)).agg(F.to_json(F.collect_list(F.struct("doc_id", "text"))).alias("value"))
    e = read_elements(spark, landed(d.select("value"), True), size=1 << 17).select(F.from_json("value", "doc_id long, text string").alias("e"))
    return e.select("e.doc_id", F.length("e.text").cast("long").alias("n_chars"), F.sha2("e.text", 256).alias("text_sha256"))


@query("result_ranges", "SELECT o_orderkey AS id, o_totalprice::VARCHAR AS pbt FROM orders")
def _(spark, sf):
    """Results in one list a month, bare or wrapped, read by ranges."""
    rec = F.create_map(F.lit("PBT"), F.col("o_totalprice").cast("string"), F.lit("id"), F.col("o_orderkey").cast("string"))
    months = A.read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyyMM").cast("int").alias("m")).agg(F.collect_list(rec).alias("records"))
    value = F.when(F.col("m") % 2 == 0, F.to_json(F.create_map(F.lit("Result"), F.col("records")))).otherwise(F.to_json("records"))
    return R.read_results(spark, landed(months.select(value.alias("value")), True), size=1 << 14).select(F.col("rec")["id"].cast("long").alias("id"), F.col("rec")["PBT"].alias("pbt"))


@query("statement_files", "SELECT o_custkey::VARCHAR AS symbol, 'income' AS statement, 'EBITDA' AS item, CAST(o_orderdate AS DATE) AS period_end, o_totalprice AS value FROM orders")
def _(spark, sf):
    to = scratch(spark)
    A.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.lit("income").alias("statement"), F.lit("EBITDA").alias("item"), F.col("o_orderdate").cast("string").alias("period_end"), F.col("o_totalprice").cast("string").alias("value"), F.lit(1).alias("more")).write.parquet(to)
    return R.read_statements(spark, to)


@query("page_files", "SELECT doc_id, 1 AS page_no, text, lang AS cell FROM documents")
def _(spark, sf):
    to = scratch(spark)
    A.read(spark, sf, "documents").select("doc_id", F.lit(1).alias("page_no"), "text", F.array(F.array(F.array("lang"))).alias("tables"), "source").write.parquet(to)
    return R.read_pages(spark, to).select("doc_id", "page_no", "text", F.col("tables")[0][0][0].alias("cell"))


@query("notes_file", "SELECT c_custkey AS company_id, c_mktsegment AS note FROM customer WHERE c_custkey % 2 = 0")
def _(spark, sf):
    from creditlake import schemas

    k = F.col("c_custkey")
    note = F.when(k % 2 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(F.lit(" "))
    maps = A.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(k.cast("string"), note)))).alias("value")).select("value")
    return R.import_notes(spark, landed(maps, True), spark.createDataFrame([], schemas.NOTES)).select("company_id", "note")


@query("equity_csv", "SELECT 'S' || s_suppkey AS symbol, s_name AS name, 'INE' || s_suppkey AS isin FROM supplier")
def _(spark, sf):
    to, k = scratch(spark), F.col("s_suppkey").cast("string")
    A.read(spark, sf, "supplier").select(F.concat(F.lit("S"), k).alias(" SYMBOL"), F.col("s_name").alias("NAME OF COMPANY "), F.concat(F.lit("ine"), k).alias(" ISIN NUMBER")).write.csv(to, header=True)
    return R.read_equity_csv(spark, to).select("symbol", "name", "isin")


@query("write_and_read_tables", with_tables("SELECT id, agency, rating_symbol FROM ratings", "ratings"))
def _(spark, sf):
    return spark.read.parquet(W.write_table(A.ratings(spark, sf), scratch(spark), "ratings")).select("id", "agency", "rating_symbol")


@query("export_screen", with_tables('SELECT "Company Name", "Agency", "Grade"::INTEGER AS "Grade" FROM screened WHERE "Grade" BETWEEN 1 AND 20', "screened"))
def _(spark, sf):
    screened = S.screen(A.companies(spark, sf), A.ratings(spark, sf), A.financials(spark, sf), order=False)
    out = spark.read.csv(W.export_screen(screened, scratch(spark)), header=True)
    return out.select("Company Name", "Agency", F.col("Grade").cast("int"))


@query("name_index_round_trip", "SELECT lower(c_name) AS key, c_name AS name, '2024-03-31' AS last_date FROM customer")
def _(spark, sf):
    to = scratch(spark)
    W.save_index(A.read(spark, sf, "customer").select(F.lower("c_name").alias("key"), F.col("c_name").alias("name")), "2024-03-31", to)
    index, last = W.load_index(spark, to)
    return index.withColumn("last_date", F.lit(last))


@query("backup", with_tables("SELECT id FROM companies", "companies"))
def _(spark, sf):
    return spark.read.parquet(W.write_backup(A.companies(spark, sf), f"{scratch(spark)}/companies")).select("id")


@query("stream_ingest", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type")
def _(spark, sf):
    """Events landed as JSON, streamed in batches into a table that each batch adds its counts to."""
    from creditlake.streaming.ingest import stream_ingest

    to = scratch(spark)
    A.read(spark, sf, "events").select("event_id", "event_type").repartition(3).write.json(f"{to}/landed")

    def add(batch, number):
        batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id")).write.mode("overwrite").parquet(f"{to}/counts/batch={number}")

    stream_ingest(spark, f"{to}/landed", "event_id long, event_type string", add, f"{to}/offsets").awaitTermination()
    return spark.read.parquet(f"{to}/counts").groupBy("event_type").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
