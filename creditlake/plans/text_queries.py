"""Queries of rating texts, numbers, years, labels and financial tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditlake import dims
from creditlake.functions import names as T
from creditlake.functions import numbers as N
from creditlake.functions import ratings as R
from creditlake.operators import financials as X
from creditlake.plans import adapters as A
from creditlake.plans.adapters import _list, with_tables
from creditlake.plans.registry import query

_FORMS = ["%S (Stable)", "%S; Negative", "--, %S ISSUER NOT COOPERATING", "%S/Positive", "(%S) watch with negative implications", "%S Reaffirmed; stable", "A1+; %S under watch"]


def _symbols(spark, sf):
    """id, raw: rating texts of several forms."""
    r = A.ratings(spark, sf)
    form = F.array(*(F.lit(f) for f in _FORMS))[(F.col("id") % len(_FORMS)).cast("int")]
    return r.select("id", F.replace(form, F.lit("%S"), F.coalesce("rating_symbol", F.lit("CARE CCC"))).alias("raw"))


_RAW = f"(SELECT id, replace({_list(_FORMS)}[id % {len(_FORMS)} + 1], '%S', coalesce(rating_symbol, 'CARE CCC')) AS raw FROM ratings)"
_OUTLOOK = "CASE " + " ".join(f"WHEN regexp_matches(raw, '{p}', 'i') THEN '{v}'" for p, v in dims.OUTLOOKS) + " ELSE '' END"
_SYMS = "|".join(s.replace("+", r"\+") for s in sorted(dims.SYMBOLS, key=len, reverse=True))
_BARE = f"trim(regexp_replace(trim(seg), '^(?:{'|'.join(dims.AGENCY_PREFIXES)})+', '', 'i'))"
_PLAIN = rf"regexp_replace(trim(regexp_replace(trim(regexp_replace({_BARE}, '\([^)]*\)', '', 'g')), '\b({dims.ACTION_WORDS})\b.*', '', 'i')), '[^A-Za-z0-9+\-]', ' ', 'g')"


def _found(text: str) -> str:
    return f"nullif(upper(regexp_extract(' ' || {text} || ' ', '(?:^|[^A-Za-z0-9])({_SYMS})(?:$|[^A-Za-z0-9])', 1, 'i')), '')"


_NORMAL = f"""WITH raws AS {_RAW}, seg AS (SELECT id, unnest(regexp_split_to_array(raw, '[,;]')) AS seg, generate_subscripts(regexp_split_to_array(raw, '[,;]'), 1) AS k FROM raws),
b AS (SELECT id, arg_min(s, k) AS base FROM (SELECT id, k, coalesce({_found(_PLAIN)}, {_found(_BARE)}) AS s FROM seg) WHERE s IS NOT NULL GROUP BY id)
SELECT raws.id, b.base, CAST(list_position({_list(dims.SYMBOLS)}, b.base) AS INTEGER) AS grade, {_OUTLOOK} AS outlook FROM raws LEFT JOIN b USING (id)"""


@query("normalize_rating", with_tables(_NORMAL, "ratings"))
def _(spark, sf):
    return R.with_rating(_symbols(spark, sf), "raw").select("id", "rating.*")


@query("extract_outlook", with_tables(f"SELECT id, {_OUTLOOK} AS outlook FROM {_RAW}", "ratings"))
def _(spark, sf):
    return _symbols(spark, sf).select("id", R.extract_outlook(F.col("raw")).alias("outlook"))


_SECTOR = "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{v}'" for w, v in dims.SECTOR_WORDS) + " ELSE '' END"


@query("keyword_sector", f"SELECT p_partkey AS id, {_SECTOR} AS sector FROM (SELECT p_partkey, lower(p_name || ' ' || p_type || ' ' || {_list([w for w, _ in dims.SECTOR_WORDS])}[p_partkey % 141 + 1]) AS t FROM part)")
def _(spark, sf):
    word = F.array(*(F.lit(w) for w, _ in dims.SECTOR_WORDS))[(F.col("p_partkey") % 141).cast("int")]
    return A.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.keyword_sector(F.col("p_name"), F.concat("p_type", F.lit(" "), word)).alias("sector"))


_CRITERIA = "CASE " + " ".join(f"WHEN contains(t, '{w}') THEN '{v}'" for w, v in dims.CRITERIA_SECTORS) + " ELSE '' END"


@query("criteria_sector", f"SELECT p_partkey AS id, {_CRITERIA} AS sector FROM (SELECT p_partkey, 'criteria for ' || coalesce({_list([w for w, _ in dims.CRITERIA_SECTORS])}[p_partkey % 15 + 1], 'x') AS t FROM part)")
def _(spark, sf):
    word = F.coalesce(F.try_element_at(F.array(*(F.lit(w) for w, _ in dims.CRITERIA_SECTORS)), (F.col("p_partkey") % 15 + 1).cast("int")), F.lit("x"))
    return A.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.sector_from_criteria(F.concat(F.lit("criteria for "), word)).alias("sector"))


_KINDS = ["Commercial Paper", "Long Term loans", "Short term and long-term", "NCD", "Bank CP", "short-term debt"]


@query("instrument_types", with_tables(f"SELECT id, CASE WHEN regexp_matches(lower(n), 'commercial paper| cp|short term|short-term') OR regexp_matches(upper(coalesce(s, '')), 'A[1-4]') THEN 'ST' ELSE 'LT' END AS by_symbol, CASE WHEN contains(lower(n), 'short') AND contains(lower(n), 'long') THEN 'LT/ST' WHEN contains(lower(n), 'short') OR contains(lower(n), 'commercial paper') THEN 'ST' ELSE 'LT' END AS by_name FROM (SELECT id, {_list(_KINDS)}[id % 6 + 1] AS n, CASE WHEN id % 7 = 0 THEN 'IND A1+' ELSE rating_symbol END AS s FROM ratings)", "ratings"))
def _(spark, sf):
    name = F.array(*(F.lit(k) for k in _KINDS))[(F.col("id") % 6).cast("int")]
    symbol = F.when(F.col("id") % 7 == 0, F.lit("IND A1+")).otherwise(F.col("rating_symbol"))
    return A.ratings(spark, sf).select("id", R.instrument_type_by_symbol(name, symbol).alias("by_symbol"), R.instrument_type_by_name(name).alias("by_name"))


_SUGGEST = ["%N:Rating of %S / Stable reaffirmed on 12 Mar 2024", "%N:''%S'' assigned; outlook Positive dated 2024-01-31", "%N no colon", "%N:CRISIL Ratings has withdrawn", " :blank name", "%N:%S/Negative"]
_VALUE = f"(SELECT id, replace(replace({_list(_SUGGEST)}[id % 6 + 1], '%N', 'Firm ' || company_id), '%S', CASE WHEN rating_grade IS NULL THEN 'CRISIL A1+' ELSE 'CRISIL ' || {_list(dims.SYMBOLS)}[rating_grade] END) AS v FROM ratings)"
_SUGGEST_SQL = rf"""WITH a AS (SELECT id, trim(split_part(v, ':', 1)) AS name, trim(regexp_replace(v, '^[^:]*:', '')) AS action FROM {_VALUE} WHERE contains(v, ':') AND trim(split_part(v, ':', 1)) <> ''),
f AS (SELECT *, trim(regexp_extract(action, '(CRISIL\s+[A-Z]{{1,3}}[+\-]?(?:\s*/\s*[A-Za-z]+)?)', 1, 'i')) AS found, nullif(regexp_extract(action, '\b(Stable|Positive|Negative|Watch|Developing)\b', 1, 'i'), '') AS said FROM a),
g AS (SELECT *, trim(split_part(found, '/', 1)) AS raw, nullif(trim(split_part(found, '/', 2)), '') AS slash FROM f),
n AS (SELECT *, nullif(upper(regexp_extract(' ' || trim(regexp_replace(raw, '^CRISIL\s+', '', 'i')) || ' ', '(?:^|[^A-Za-z0-9])({_SYMS})(?:$|[^A-Za-z0-9])', 1, 'i')), '') AS base FROM g)
SELECT id, name AS company_name, raw AS raw_rating, CAST(list_position({_list(dims.SYMBOLS)}, base) AS INTEGER) AS rating_grade, coalesce(upper(said[1]) || lower(said[2:]), upper(slash[1]) || lower(slash[2:]), '') AS outlook,
  nullif(regexp_extract(action, '\b(\d{{1,2}}[\s\-/][A-Za-z]{{3}}[\s\-/]\d{{2,4}}|\d{{4}}[\-/]\d{{2}}[\-/]\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}})\b', 1), '') AS rating_date FROM n"""


@query("parse_suggest", with_tables(_SUGGEST_SQL, "ratings"))
def _(spark, sf):
    form = F.array(*(F.lit(f.replace("''", "'")) for f in _SUGGEST))[(F.col("id") % 6).cast("int")]
    grade = F.try_element_at(F.array(*(F.lit(s) for s in dims.SYMBOLS)), F.col("rating_grade"))
    symbol = F.coalesce(F.concat(F.lit("CRISIL "), grade), F.lit("CRISIL A1+"))
    v = F.replace(F.replace(form, F.lit("%N"), F.concat(F.lit("Firm "), F.col("company_id").cast("string"))), F.lit("%S"), symbol)
    return A.ratings(spark, sf).select("id", R.parse_suggest(v).alias("p")).where("p is not null").select("id", "p.company_name", "p.raw_rating", "p.rating_grade", "p.outlook", "p.rating_date")


#: # is the part's key.
_NUMBERS = ["#,234.5", "(#)", "-#.2", "#,234.5 Cr", "(#.5) %", "--", "#**", "N/A", "", "#d", "(#", "#.", " # "]
_AT = f"(SELECT p_partkey AS id, replace({_list(_NUMBERS)}[p_partkey % {len(_NUMBERS)} + 1], '#', p_partkey::VARCHAR) AS t FROM part)"
_OK = r"regexp_matches({0}, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')"


def _num(e: str) -> str:
    return f"CASE WHEN {_OK.format(e)} THEN CAST({e} AS DOUBLE) END"


def _brackets(e: str) -> str:
    return f"CASE WHEN starts_with({e}, '(') AND ends_with({e}, ')') THEN '-' || {e}[2:-2] ELSE {e} END"


_BSE = "regexp_replace(trim(replace(t, ',', '')), '[A-Za-z%\\s]+$', '')"
_PDF = "regexp_replace(" + _brackets("replace(replace(trim(t), ',', ''), ' ', '')") + ", '[A-Za-z%]+$', '')"
_PLAIN_NUMBER = "trim(replace(t, ',', ''))"
_DIGITS = "regexp_replace(t, '[^0-9.]', '', 'g')"
_CARE = "trim(regexp_replace(replace(trim(t), ',', ''), '\\*+$', ''))"


@query("amounts", f"SELECT id, {_num(_PLAIN_NUMBER)} AS plain, {_num(_brackets(_BSE))} AS bse, {_num(_PDF)} AS pdf, CASE WHEN trim(t) NOT IN ('', '-', 'N/A', 'NA', 'Nil', '--') THEN CASE WHEN starts_with(trim(t), '(') AND ends_with(trim(t), ')') THEN -({_num(_DIGITS)}) ELSE {_num(_DIGITS)} END END AS crisil, CASE WHEN replace(trim(t), ',', '') NOT IN ('-', '--', 'na', 'n.a.', 'n/a', '') THEN {_num(_CARE)} END AS care, {_num(_DIGITS)} AS digits FROM {_AT}")
def _(spark, sf):
    t = F.replace(F.array(*(F.lit(x) for x in _NUMBERS))[(F.col("p_partkey") % len(_NUMBERS)).cast("int")], F.lit("#"), F.col("p_partkey").cast("string"))
    p = A.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), t.alias("t"))
    c = F.col("t")
    return p.select("id", N.amount_plain(c).alias("plain"), N.amount_bse(c).alias("bse"), N.amount_pdf(c).alias("pdf"), N.amount_crisil(c).alias("crisil"), N.amount_care(c).alias("care"), N.amount_digits(c).alias("digits"))


_UNIT_TEXTS = ["Rs. Lakh", "in millions", "(bn) and in lakhs", "Rs crore", "in  billion", "(Mn)", ""]
_DETECT = r"CASE WHEN regexp_matches(lower({0}), 'in\s+lakh|rs\.?\s*lakh|\(lakh') THEN 0.01 WHEN regexp_matches(lower({0}), 'in\s+million|rs\.?\s*million|\(mn\)') THEN 0.1 WHEN regexp_matches(lower({0}), 'in\s+billion|rs\.?\s*billion|\(bn\)') THEN 100.0 ELSE 1.0 END::DOUBLE"
_UNIT_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.UNITS.items()) + " ELSE 1.0 END::DOUBLE"


@query("units", f"SELECT p_partkey AS id, {_DETECT.format(_list(_UNIT_TEXTS) + '[p_partkey % 7 + 1]')} AS declared, p_size * {_UNIT_CASE.format('trim(lower(' + _list([' Crore', 'LAKHS', 'bn', 'xx']) + '[p_partkey % 4 + 1]))')} AS value FROM part")
def _(spark, sf):
    key = F.col("p_partkey")
    unit = F.array(*(F.lit(u) for u in (" Crore", "LAKHS", "bn", "xx")))[(key % 4).cast("int")]
    return A.read(spark, sf, "part").select(key.alias("id"), N.detect_unit(F.array(*(F.lit(u) for u in _UNIT_TEXTS))[(key % 7).cast("int")]).alias("declared"), N.apply_unit(F.col("p_size").cast("double"), unit).alias("value"))


#: # is a number of two digits made from the part's key.
_YEARS = ["FY#", "FY20#", "20#-25", "Mar-#", "March 31, 20# (A)", "19#", "9MFY#", "FY 49", "FY 60", "H1 FY#", "Mar 20#", "none"]
_YEAR_SQL = r"""SELECT id, CASE WHEN a <> '' THEN 2000 + a::INTEGER WHEN b <> '' THEN CASE WHEN b::INTEGER < 50 THEN 2001 ELSE 1901 END + b::INTEGER END AS generic, CASE WHEN y BETWEEN 2000 AND 2030 THEN y END AS crisil,
  CASE WHEN c1 <> '' THEN c1::INTEGER WHEN c2 <> '' THEN c2::INTEGER WHEN c3 <> '' THEN 2000 + c3::INTEGER END AS care FROM (SELECT *, CASE WHEN n >= 100 THEN n WHEN n < 50 THEN 2000 + n ELSE 1900 + n END AS y FROM (
  SELECT id, regexp_extract(t, '20(\d{2})', 1) AS a, regexp_extract(t || ' ', 'FY\s*(\d{2})\D', 1, 'i') AS b, CAST(coalesce(nullif(regexp_extract(t, '\bFY\s*(\d{4})\b|\bMar[- ](\d{2,4})\b|\b(\d{4})\b', 1, 'i'), ''), nullif(regexp_extract(t, '\bFY\s*(\d{4})\b|\bMar[- ](\d{2,4})\b|\b(\d{4})\b', 2, 'i'), ''), nullif(regexp_extract(t, '\bFY\s*(\d{4})\b|\bMar[- ](\d{2,4})\b|\b(\d{4})\b', 3, 'i'), '')) AS INTEGER) AS n,
  regexp_extract(t, 'march\s+\d{1,2},?\s*(\d{4})', 1, 'i') AS c1, regexp_extract(t, '\bFY\s*(20\d{2})\b', 1, 'i') AS c2, regexp_extract(t, '\bFY\s*(\d{2})\b', 1, 'i') AS c3 FROM (SELECT p_partkey AS id, replace(%s[p_partkey %% 12 + 1], '#', (p_partkey // 12 %% 90 + 10)::VARCHAR) AS t FROM part)))"""


@query("fiscal_years", _YEAR_SQL.replace("%s", _list(_YEARS)).replace("%%", "%"))
def _(spark, sf):
    two = F.floor(F.col("p_partkey") / 12) % 90 + 10
    t = F.replace(F.array(*(F.lit(y) for y in _YEARS))[(F.col("p_partkey") % 12).cast("int")], F.lit("#"), two.cast("string"))
    return A.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.year_from_header(t).alias("generic"), N.year_header_crisil(t).alias("crisil"), N.fiscal_year_care(t).alias("care"))


_LABELS = ["Total operating income", "PBILDT margin", "Net profit", "Overall debt service cover", "Total debt / PBILDT", "Cash and cash equivalents", "Capital expenditure", "Net worth", "Profit after tax (PAT)", "EBITDA margin (%)"]
_CARE_RULE = "CASE " + " ".join(f"WHEN {(' AND ' if every else ' OR ').join(f'contains(l, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{f}'" for f, every, words in dims.BRIEF_RULES) + " END"
_PAGE_RULE = "CASE " + " ".join(f"WHEN contains(l, '{w}') THEN '{f}'" for w, f in dims.PAGE_LABELS) + " END"


@query("labels_to_fields", f"SELECT id, {_CARE_RULE} AS brief, {_PAGE_RULE} AS page FROM (SELECT p_partkey AS id, lower({_list(_LABELS)}[p_partkey % 10 + 1] || ' ' || p_name) AS l FROM part)")
def _(spark, sf):
    label = F.concat(F.array(*(F.lit(x) for x in _LABELS))[(F.col("p_partkey") % 10).cast("int")], F.lit(" "), "p_name")
    return A.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), N.map_label_care(label).alias("brief"), N.map_label_page(label).alias("page"))


@query("confidence", with_tables("SELECT id, round(((revenue_cr IS NOT NULL)::INT + (ebitda_cr IS NOT NULL)::INT + (pat_cr IS NOT NULL)::INT + (total_debt_cr IS NOT NULL)::INT + (cash_cr IS NOT NULL)::INT + (capex_cr IS NOT NULL)::INT) / 6.0::DOUBLE, 2) AS generic, round(((coalesce(revenue_cr, 0) <> 0)::INT + (coalesce(ebitda_cr, 0) <> 0)::INT + (coalesce(pat_cr, 0) <> 0)::INT + (coalesce(cash_cr, 0) <> 0)::INT) / 4.0::DOUBLE, 2) AS care FROM financials", "financials"))
def _(spark, sf):
    c = {k: F.col(k) for k in ("revenue_cr", "ebitda_cr", "pat_cr", "total_debt_cr", "cash_cr", "capex_cr")}
    return A.financials(spark, sf).select("id", N.confidence_generic(*c.values()).alias("generic"), N.confidence_care(c["revenue_cr"], c["ebitda_cr"], c["pat_cr"], c["cash_cr"]).alias("care"))


@query("derive_metrics", with_tables("SELECT id, n AS net_debt_cr, CASE WHEN coalesce(ebitda_cr, 0) <> 0 AND revenue_cr > 0 THEN floor(ebitda_cr / revenue_cr * 1000) END AS margin, CASE WHEN ebitda_cr > 0 THEN floor(n / ebitda_cr * 10 + 0.001) END AS leverage FROM (SELECT *, coalesce(net_debt_cr, total_debt_cr - cash_cr) AS n FROM financials)", "financials"))
def _(spark, sf):
    f = A.financials(spark, sf).drop("ebitda_margin_pct", "net_debt_ebitda")
    d = X.derive_metrics(f).join(f.select("id", F.col("ebitda_cr").alias("e"), F.col("revenue_cr").alias("r")), "id")
    # compared before rounding, as engines differ at ties
    margin = F.when(F.col("ebitda_margin_pct").isNotNull(), F.floor(F.col("e") / F.col("r") * 1000).cast("double"))
    leverage = F.when(F.col("net_debt_ebitda").isNotNull(), F.floor(F.col("net_debt_cr") / F.col("e") * 10 + 0.001).cast("double"))
    return d.select("id", "net_debt_cr", margin.alias("margin"), leverage.alias("leverage"))


@query("has_figures", with_tables("SELECT id FROM financials WHERE coalesce(pat_cr, 0) <> 0 OR coalesce(ebitda_cr, 0) <> 0 OR coalesce(CASE WHEN id % 2 = 0 THEN 0 ELSE revenue_cr END, 0) <> 0", "financials"))
def _(spark, sf):
    return X.has_figures(A.financials(spark, sf).withColumn("revenue_cr", F.when(F.col("id") % 2 != 0, F.col("revenue_cr")).otherwise(0.0))).select("id")


@query("top_years", with_tables("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY company_id ORDER BY coalesce(fiscal_year, 0) DESC, id) AS k FROM financials) WHERE k <= 2", "financials"))
def _(spark, sf):
    return X.top_n_years(A.financials(spark, sf).withColumn("seq", F.col("id")), "company_id").select("id")


def _with_text(spark, sf, planted):
    """doc_id, text: every whole text of documents, and what is planted behind it."""
    d = A.read(spark, sf, "documents")
    return d.select("doc_id", F.concat(F.coalesce("text", F.lit("")), planted).alias("text"))


_CAPEX = ["The firm planned capex of Rs 250 crore over the next 3 years. Nothing else.", "Capex Rs. 1,200 lakh is expected within 2-4 years! Capex of 5 bn.", "Capex of Rs 90 was spent. It is proposed to add capex of 40 mn and capex 7.5"]


@query("capex_plans", f"""WITH d AS (SELECT doc_id, coalesce(text, '') || '. ' || {_list(_CAPEX)}[doc_id % 3 + 1] AS t FROM documents), s AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence FROM d),
w AS (SELECT doc_id, sentence, unnest(regexp_extract_all(sentence, 'capex\\s+(?:of\\s+)?(?:Rs\\.?\\s*)?\\d[\\d,\\.]*\\s*(?:crore|cr|lakh|mn|bn|million|billion)?', 0, 'i')) AS m FROM s WHERE regexp_matches(sentence, 'over\\s+the\\s+next|planned|expected|FY2[0-9]|upcoming|envisaged|proposed', 'i')),
v AS (SELECT *, CAST(replace(regexp_extract(m, '(\\d[\\d,\\.]*)', 1), ',', '') AS DOUBLE) AS n, lower(regexp_extract(m, '(crore|cr|lakh|mn|bn|million|billion)$', 1, 'i')) AS u FROM w)
SELECT doc_id, round(n * {_UNIT_CASE.format('u')}, 2) AS amount_cr, CAST(coalesce(nullif(regexp_extract(sentence, '(\\d+)\\s*[-–]\\s*(\\d+)\\s*years?', 2, 'i'), ''), nullif(regexp_extract(sentence, 'next\\s+(\\d+)\\s+years?', 1, 'i'), '')) AS INTEGER) AS timeframe_years, sentence AS description FROM v""")
def _(spark, sf):
    t = F.concat(F.lit(". "), F.array(*(F.lit(x) for x in _CAPEX))[(F.col("doc_id") % 3).cast("int")])
    pages = _with_text(spark, sf, t).withColumn("page_no", F.lit(1))
    return X.extract_capex_plans(pages).select("doc_id", "amount_cr", "timeframe_years", "description")


_TEXT = "Revenue: Rs. %d lakh. EBITDA - 12.5 crore. PAT 3. Net Debt Rs 1,0%d.5 mn"


@query("extract_from_text", "SELECT doc_id, (doc_id % 97) * 0.01::DOUBLE AS revenue_cr, 12.5::DOUBLE AS ebitda_cr, 3.0::DOUBLE AS pat_cr, CAST('10' || doc_id % 97 || '.5' AS DOUBLE) * 0.1::DOUBLE AS net_debt_cr FROM documents")
def _(spark, sf):
    text = F.concat(F.lit("\n"), F.format_string(_TEXT, F.col("doc_id") % 97, F.col("doc_id") % 97))
    return _with_text(spark, sf, text).select("doc_id", X.extract_from_text(F.col("text")).alias("f")).select("doc_id", "f.revenue_cr", "f.ebitda_cr", "f.pat_cr", "f.net_debt_cr")


def _pages(spark, sf):
    """doc_id, page_no, text, tables: whole texts with a declared unit, and two tables of figures made from each id.

    Figures end in .7 and .9, so that no ratio of them is a tie when it is rounded.
    """
    n = F.col("doc_id")
    s = lambda c, tail="": F.concat(c.cast("string"), F.lit(tail))
    row = lambda *cells: F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cells))
    one = F.array(row("Particulars", "FY2023", "FY2024"), row("Total revenue", s(n % 50 + 1), s(n % 90 + 100, ".7")), row("EBITDA", "-", s(n % 30 + 1, ".9")), row("Cash", "1", F.concat(F.lit("("), s(n % 7), F.lit(")"))), row("Total debt", "5", s(n % 11, ".3")))
    two = F.array(row("x", "2022"), row("Turnover", "9"), row("Capex", s(n % 5)))
    return _with_text(spark, sf, F.when(n % 2 == 0, F.lit(" Rs. Lakh")).otherwise(F.lit(""))).withColumns({"page_no": F.lit(1), "tables": F.array(one, two)})


_FIGURES = """SELECT doc_id, 2024 AS fiscal_year, CAST((doc_id % 90 + 100) || '.7' AS DOUBLE) * u AS revenue_cr, CAST((doc_id % 30 + 1) || '.9' AS DOUBLE) * u AS ebitda_cr, CAST((doc_id % 11) || '.3' AS DOUBLE) * u AS total_debt_cr, -(doc_id % 7) * u AS cash_cr, (doc_id % 5) * u AS capex_cr
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0.01 ELSE 1.0 END::DOUBLE AS u FROM documents)"""


@query("process_tables", _FIGURES)
def _(spark, sf):
    return X.process_tables(_pages(spark, sf)).select("doc_id", "fiscal_year", "revenue_cr", "ebitda_cr", "total_debt_cr", "cash_cr", "capex_cr")


@query("extract_financials", f"""SELECT doc_id, fiscal_year, revenue_cr, ebitda_cr, NULL::DOUBLE AS pat_cr, total_debt_cr, cash_cr, total_debt_cr - cash_cr AS net_debt_cr, capex_cr, NULL::DOUBLE AS interest_coverage,
  round(ebitda_cr / revenue_cr * 100, 2) AS ebitda_margin_pct, round((total_debt_cr - cash_cr) / ebitda_cr, 2) AS net_debt_ebitda, 0.83::DOUBLE AS confidence FROM ({_FIGURES})""")
def _(spark, sf):
    return X.extract_financials(_pages(spark, sf))


_BLOCK = ["", "Key financial indicators (audited)", "Firm FY2024 FY2025", "Operating income 4269.1 ", "PAT 446.4 ", "OPBDIT/OI 13.9% 10.4%", "Total debt/OPBDIT (times) 0.0 0.2", "Interest coverage (times) 103.7 ", "Note: audited", "PAT 1 2"]
#: Lengths of whole texts give the figures.
_LENGTH = "(SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS len FROM documents)"


@query("extract_text_table", f"""SELECT doc_id, 2025 AS fiscal_year, n AS revenue_cr, CAST((len % 300) || '.6' AS DOUBLE) AS pat_cr, CAST((len % 40) || '.2' AS DOUBLE) AS interest_coverage, 10.4::DOUBLE AS ebitda_margin_pct, e AS ebitda_cr, CASE WHEN e > 0 THEN round(0.2::DOUBLE * e, 2) END AS total_debt_cr, NULL::DOUBLE AS net_debt_cr
  FROM (SELECT doc_id, n, len, CASE WHEN n > 0 THEN round(n * 10.4::DOUBLE / 100, 2) END AS e FROM (SELECT doc_id, len, CAST(doc_id AS DOUBLE) AS n FROM {_LENGTH}))""")
def _(spark, sf):
    text = _with_text(spark, sf, F.lit(""))
    size = F.length("text")
    ends = {"Operating income 4269.1 ": F.col("doc_id").cast("string"), "PAT 446.4 ": F.concat((size % 300).cast("string"), F.lit(".6")), "Interest coverage (times) 103.7 ": F.concat((size % 40).cast("string"), F.lit(".2"))}
    block = F.concat_ws("\n", *(F.concat(F.lit(x), ends[x]) if x in ends else F.lit(x) for x in _BLOCK))
    return X.extract_text_table(text.select("doc_id", F.concat("text", block).alias("text")))


_BRIEF = f"""WITH t AS (SELECT doc_id, 2024 AS fiscal_year, CAST((len % 40 + 10) || '.7' AS DOUBLE) AS revenue_cr, CAST(len % 9 AS DOUBLE) AS ebitda_cr, CAST(len % 4 AS DOUBLE) AS pat_cr FROM {_LENGTH} UNION ALL SELECT doc_id, 2023, len % 5 + 7.0, 2.0, NULL FROM {_LENGTH})
SELECT *, NULL::DOUBLE AS interest_coverage, NULL::DOUBLE AS total_debt_cr, NULL::DOUBLE AS net_debt_cr, NULL::DOUBLE AS cash_cr, NULL::DOUBLE AS capex_cr, CASE WHEN ebitda_cr <> 0 THEN round(ebitda_cr / revenue_cr * 100, 2) END AS ebitda_margin_pct,
  (1 + (ebitda_cr <> 0)::INT + coalesce((pat_cr <> 0)::INT, 0)) / 4.0::DOUBLE AS extraction_confidence, 'care_edge_pdf' AS data_source FROM t"""


@query("brief_financials", _BRIEF)
def _(spark, sf):
    """Tables whose figures are taken from whole texts, which stand in a row of remarks."""
    d, n = _with_text(spark, sf, F.lit("")), F.length("text")
    s = F.concat((n % 40 + 10).cast("string"), F.lit(".7")), (n % 9).cast("string"), (n % 4).cast("string")
    head = ("Brief Financials (Rs crore)", "March 31, 2023 (A)", "March 31, 2024 (A)", "9MFY25 (UA)")
    rows = ("Total operating income", (n % 5 + 7).cast("string"), s[0], "1"), ("Remarks", F.col("text"), F.col("text"), "-"), ("PBILDT", "2.0**", s[1], "-"), ("PAT", "-", s[2], "3")
    table = F.array(*(F.array(*(F.lit(c) if isinstance(c, str) else c for c in r)) for r in (head, *rows)))
    return X.parse_brief_financials(d.withColumns({"page_no": F.lit(1), "tables": F.array(table)}))


def _facilities(spark, sf):
    """Instruments whose amounts and grades are taken from whole texts, which are the note of the first."""
    d, n = _with_text(spark, sf, F.lit("")), F.length("text")
    grade = F.array(*(F.lit(x) for x in dims.SYMBOLS))
    note = F.concat(F.lit("Reaffirmed: "), F.col("text"), F.lit("."))
    table = F.array(F.array(*map(F.lit, ("Facilities/Instruments", "Amount", "Rating", "Action"))), F.array(F.lit("Long Term Bank"), F.concat((n % 90).cast("string"), F.lit(".5 (Enhanced)")), F.concat(F.lit("CARE "), grade[n % 20], F.lit("; Stable / CARE A1+")), note), F.array(F.lit("Short Term Bank"), F.lit(""), F.lit("CARE A; Negative"), F.lit("Assigned")))
    return d.withColumns({"page_no": F.lit(1), "tables": F.array(table)})


_FACILITIES = f"SELECT doc_id, 1 AS row_no, 'Long Term Bank' AS instrument_name, 'LT' AS instrument_type, CAST(len % 90 || '.5' AS DOUBLE) AS rated_amount_cr, {A._list(dims.SYMBOLS)}[len % 20 + 1] AS rating_symbol, CAST(len % 20 + 1 AS INTEGER) AS rating_grade, 'Stable' AS outlook, 'Reaffirmed: ' || text || '.' AS rating_action FROM {_LENGTH} UNION ALL SELECT doc_id, 2, 'Short Term Bank', 'ST', NULL, 'A', 6, 'Negative', 'Assigned' FROM documents"


@query("rating_table", _FACILITIES)
def _(spark, sf):
    return X.parse_rating_table(_facilities(spark, sf))


@query("best_instrument", f"SELECT doc_id, arg_min(instrument_name, (rating_grade, row_no)) AS instrument_name, min(rating_grade) AS rating_grade, arg_min(rating_action, (rating_grade, row_no)) AS rating_action FROM ({_FACILITIES}) GROUP BY doc_id")
def _(spark, sf):
    return X.best_instrument(X.parse_rating_table(_facilities(spark, sf))).select("doc_id", "instrument_name", "rating_grade", "rating_action")


@query("release_dates_and_sentences", "SELECT doc_id, 'March ' || (doc_id % 28 + 1) || ', 2024' AS released, len(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentences FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^a-z.!? ]', '', 'g') AS t FROM documents)")
def _(spark, sf):
    d = A.read(spark, sf, "documents")
    text = F.concat(F.lit("Mumbai, March "), (F.col("doc_id") % 28 + 1).cast("string"), F.lit(", 2024: "), F.coalesce("text", F.lit("")))
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-z.!? ]", "")
    return d.select("doc_id", X.extract_release_date(text).alias("released"), F.size(N.split_sentences(plain)).cast("long").alias("sentences"))


@query("extract_industry", "SELECT doc_id, 'Sector ' || doc_id % 13 AS industry FROM documents WHERE doc_id % 3 <> 0")
def _(spark, sf):
    table = F.array(F.array(F.lit("Macro"), F.lit("Industry")), F.array(F.lit("None"), F.concat(F.lit("Sector "), (F.col("doc_id") % 13).cast("string"))))
    text = F.when(F.col("doc_id") % 3 != 0, F.lit(" Industry Classification")).otherwise(F.lit(" other"))
    return X.extract_industry(_with_text(spark, sf, text).withColumns({"page_no": F.lit(2), "tables": F.array(table)}))


_RESULTS = """WITH r AS (SELECT o_custkey::VARCHAR AS scrip_cd, o_orderkey AS seq, year(o_orderdate) AS y, floor(o_totalprice * 3) AS sales, o_totalprice AS pbt, o_orderkey % 9 AS dep, [0, 1, 3, 9][o_orderkey % 4 + 1] AS fin,
  floor(o_totalprice / 2) AS pat, floor(o_totalprice / 7) AS debt, o_orderkey % 13 AS cash, o_orderkey % 5 AS capex FROM orders WHERE o_orderkey % 4 <> 1),
k AS (SELECT *, row_number() OVER (PARTITION BY scrip_cd ORDER BY y DESC, seq) AS n, CASE WHEN sales > 100000 THEN 0.01 ELSE 1.0 END::DOUBLE AS u FROM r),
v AS (SELECT scrip_cd, seq, CAST(y AS INTEGER) AS fiscal_year, sales * u AS revenue_cr, pbt * u + dep * u + fin * u AS ebitda_cr, pat * u AS pat_cr, debt * u AS total_debt_cr, cash * u AS cash_cr, debt * u - cash * u AS net_debt_cr, capex * u AS capex_cr, fin * u AS cost FROM k WHERE n <= 2)
SELECT * EXCLUDE (cost), CASE WHEN revenue_cr > 0 THEN round(ebitda_cr / revenue_cr * 100, 2) END AS ebitda_margin_pct, CASE WHEN cost > 0 THEN round(ebitda_cr / cost, 2) END AS interest_coverage, CASE WHEN ebitda_cr > 0 THEN round(net_debt_cr / ebitda_cr, 2) END AS net_debt_ebitda FROM v"""


@query("annual_results", _RESULTS)
def _(spark, sf):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    kind = F.when(k % 4 == 0, "A").when(k % 4 == 1, "Q").when(k % 4 == 3, "Annual")
    cost = F.get(F.array(*map(F.lit, (0, 1, 3, 9))), (k % 4).cast("int"))
    said = {"PeriodType": kind, "Date": F.concat(F.lit("31 Mar "), F.year("o_orderdate").cast("string")), "SALES_AMT": F.lit("N.A."), "Revenue": F.floor(price * 3), "PBT": price, "Depreciation": k % 9, "FinanceCost": cost, "PAT": F.floor(price / 2), "Borrowings": F.floor(price / 7), "Cash": k % 13, "NetCapex": k % 5}
    rec = F.create_map(*(x for name, v in said.items() for x in (F.lit(name), v.cast("string"))))
    return X.annual_results(A.read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("scrip_cd"), k.alias("seq"), rec.alias("rec")))


_STATEMENT = """WITH l AS (SELECT company_id, fiscal_year, floor(max(revenue_cr)) * 100000 * 1e-7 AS r, (max(total_debt_cr) * 3 + 0.7) * 1e-7 * 1e6 AS e, max(total_debt_cr) * 1e7 * 1e-7 AS d, max(cash_cr) * 1e7 * 1e-7 AS c, max(pat_cr) * 1e7 * 1e-7 AS p, -max(cash_cr) * 1e6 * 1e-7 AS x FROM financials GROUP BY company_id, fiscal_year),
k AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC) AS n FROM l)
SELECT company_id::VARCHAR AS symbol, fiscal_year, round(r, 2) AS revenue_cr, round(e, 2) AS ebitda_cr, round(p, 2) AS pat_cr, round(d, 2) AS total_debt_cr, round(c, 2) AS cash_cr, round(d - c, 2) AS net_debt_cr, round(abs(x), 2) AS capex_cr, CASE WHEN r > 0 THEN round(e / r * 100, 2) END AS ebitda_margin_pct, CASE WHEN e > 0 THEN round((d - c) / e, 2) END AS net_debt_ebitda FROM k WHERE n <= 2"""


@query("statement_financials", with_tables(_STATEMENT, "financials"))
def _(spark, sf):
    f = A.financials(spark, sf).groupBy("company_id", "fiscal_year").agg(F.max("revenue_cr").alias("r"), F.max("total_debt_cr").alias("d"), F.max("cash_cr").alias("c"), F.max("pat_cr").alias("p"))
    lines = (("income", "Operating Revenue", F.floor("r") * 100000.0), ("income", "EBITDA", (F.col("d") * 3 + 0.7) * 1e6), ("income", "Net Income", F.col("p") * 1e7), ("balance", "Total Debt", F.col("d") * 1e7), ("balance", "Cash And Cash Equivalents", F.col("c") * 1e7), ("cashflow", "Capital Expenditure", -F.col("c") * 1e6), ("income", "Total Revenue", F.lit(float("nan"))))
    items = F.array(*(F.struct(F.lit(s).alias("statement"), F.lit(i).alias("item"), v.alias("value")) for s, i, v in lines))
    long = f.select(F.col("company_id").cast("string").alias("symbol"), F.make_date("fiscal_year", F.lit(3), F.lit(31)).alias("period_end"), F.explode(items).alias("x")).select("symbol", "period_end", "x.*")
    return X.statement_financials(long)


@query("tag_source", with_tables("SELECT id, 'bse_xbrl' AS data_source, 0.85::DOUBLE AS extraction_confidence FROM financials", "financials"))
def _(spark, sf):
    return X.tag_source(A.financials(spark, sf), "bse").select("id", "data_source", "extraction_confidence")


@query("rationale_urls", with_tables("SELECT id, CASE agency WHEN 'ICRA' THEN 'https://www.icra.in/Rating/RatingDetails?CompanyId=' || company_id || '&CompanyName=A%20%26%20B/' || id WHEN 'CRISIL' THEN CASE WHEN id % 2 = 0 THEN 'https://www.crisilratings.com/mnt/winshare/Ratings/RatingList/RatingDocs/f%20' || id || '.html' ELSE 'https://www.crisilratings.com/en/home/our-business/ratings/rating-rationale.html' END WHEN 'India Ratings' THEN 'https://www.indiaratings.co.in/Issuers?issuerID=' || company_id WHEN 'CARE Edge' THEN 'https://www.careratings.com/upload/CompanyFiles/PR/' || CASE WHEN id % 2 = 0 THEN 'f ' || id || '.html' ELSE '' END END AS url, CASE WHEN id % 2 = 0 THEN 'f ' || id || '.html' ELSE '' END AS file FROM ratings", "ratings"))
def _(spark, sf):
    key = F.col("id").cast("string")
    file = F.when(F.col("id") % 2 == 0, F.concat(F.lit("f "), key, F.lit(".html"))).otherwise(F.lit(""))
    return A.ratings(spark, sf).select("id", T.rationale_url(F.col("agency"), F.col("company_id").cast("string"), F.concat(F.lit("A & B/"), key), file).alias("url"), T.last_segment(F.concat(F.lit("a/b/"), file)).alias("file"))


@query("search_terms", with_tables("SELECT id, CASE WHEN w IS NULL THEN [name] ELSE [name, w] END AS terms FROM (SELECT id, name, list_filter(regexp_split_to_array(name, '\\s+'), lambda x: length(x) > 3)[1] AS w FROM companies)", "companies"))
def _(spark, sf):
    return A.companies(spark, sf).select("id", T.search_terms(F.col("name")).alias("terms"))
