"""Figures from tables, texts, result records and statements.

Tables are arrays of rows of cells, in the order (page, table, row); first-wins and last-wins are min_by and max_by over that order,
so merges combine before the exchange.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditlake import dims
from creditlake.functions.names import bind, none_if_empty, strip
from creditlake.functions.numbers import (
    amount_bse, amount_care, amount_crisil, amount_digits, amount_pdf, apply_unit, confidence_care, confidence_generic, detect_unit,
    fiscal_year_care, map_label_care, map_label_page, split_sentences, truthy, year_columns, year_from_header, year_header_crisil,
)
from creditlake.functions.ratings import instrument_type_by_name, normalize_rating

FIELDS = list(dims.TABLE_LABELS)


def _cell(row: Column, place: Column) -> Column:
    return F.try_element_at(row, (place + 1).cast("int"))


def table_rows(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, table_no, row_no, cells: one row for each row of each table."""
    t = pages.select("doc_id", "page_no", "text", F.posexplode("tables").alias("table_no", "table"))
    return t.select("doc_id", "page_no", "text", "table_no", "table", F.posexplode("table").alias("row_no", "cells"))


def process_tables(pages: DataFrame) -> DataFrame:
    """doc_id, fiscal_year and a column for each field: in the newest year's column, the first row whose label names the field.

    The first value in (page, table, row) order wins for each document; the year likewise.
    """
    t = pages.select("doc_id", "page_no", F.coalesce("text", F.lit("")).alias("text"), F.posexplode("tables").alias("table_no", "table")).where(F.size("table") >= 2)
    header = F.col("table")[0]
    t = t.withColumns({"years": year_columns(header), "unit": detect_unit(F.col("text"))})
    year_place = F.try_element_at("years", F.lit(1))
    t = t.withColumns({"target": F.coalesce(year_place, F.size(header) - 1), "year": F.when(year_place.isNotNull(), year_from_header(_cell(header, year_place)))})
    rows = t.select("doc_id", "page_no", "table_no", "target", "unit", "year", F.posexplode("table").alias("row_no", "cells")).where((F.col("row_no") > 0) & (F.size("cells") >= 2))
    at = F.struct("page_no", "table_no", "row_no")
    label, value = strip(F.lower(F.col("cells")[0])), amount_pdf(_cell(F.col("cells"), F.col("target"))) * F.col("unit")
    rows = rows.select("doc_id", at.alias("at"), "year", label.alias("label"), value.alias("value"))
    picks = []
    for field, words in dims.TABLE_LABELS.items():
        named = F.col("label").rlike("|".join(map(re.escape, words)).replace(r"\ ", " "))
        picks.append(F.min_by("value", F.when(named & F.col("value").isNotNull(), F.col("at"))).alias(field))
    years = t.groupBy("doc_id").agg(F.min_by("year", F.when(F.col("year").isNotNull(), F.struct("page_no", "table_no"))).alias("fiscal_year"))
    return years.join(rows.groupBy("doc_id").agg(*picks), "doc_id", "left")


def extract_from_text(text: Column) -> Column:
    """struct of fields: the first word, in order, that has a figure behind it; a unit behind that beats the block's."""

    def of(words: list[str]) -> Column:
        patterns = F.array(*(F.lit(rf"(?i){re.escape(w)}\s*[:\-]?\s*(?:Rs\.?\s*)?(\d[\d,\.]*)\s*(crore|cr|lakh|mn|bn|million|billion)?") for w in words))
        parts = F.transform(patterns, lambda p: F.struct(*(F.call_function("regexp_extract", text, p, F.lit(i)).alias(n) for i, n in ((1, "value"), (2, "unit")))))
        values = F.transform(parts, lambda x: amount_pdf(x["value"]) * F.when(x["unit"] != "", apply_unit(F.lit(1.0), x["unit"])).otherwise(detect_unit(text)))
        return F.try_element_at(F.array_compact(values), F.lit(1))

    return F.struct(*(of(words).alias(field) for field, words in dims.TEXT_WORDS.items()))


def extract_text_table(texts: DataFrame) -> DataFrame:
    """doc_id and the figures of a 'Key financial indicators' block of plain text.

    The block is 3000 characters. Years are those of the first line that has any; figures of a line are read from its end; lines
    count until a heading. EBITDA comes from revenue and margin, debts from their ratios to EBITDA.
    """
    start = F.regexp_instr("text", F.lit(dims.TEXT_HEADING))
    b = texts.where(start > 0).select("doc_id", F.substring(F.col("text"), start, F.lit(3000)).alias("block"))
    lines = b.select("doc_id", "block", F.posexplode(F.split("block", "\r\n|\n|\r")).alias("n", "line")).where("n > 0")
    years = lines.withColumn("years", F.regexp_extract_all("line", F.lit(dims.TEXT_YEAR), F.lit(0))).where(F.size("years") > 0)
    years = years.groupBy("doc_id").agg(F.min_by(F.struct("n", "years"), "n").alias("y")).select("doc_id", F.col("y.n").alias("at"), F.col("y.years").alias("years"))
    rest = lines.join(years, "doc_id").where("n > at").withColumn("line", strip(F.col("line"))).where("line <> ''")
    heading = reduce(lambda a, b: a | b, (F.col("line").rlike(p) for p in dims.TEXT_SECTION_ENDS))
    ends = rest.where(heading).groupBy("doc_id").agg(F.min("n").alias("stop"))
    rest = rest.join(ends, "doc_id", "left").where("stop is null or n < stop").withColumn("figures", F.regexp_extract_all("line", F.lit(dims.TEXT_FIGURE), F.lit(0)))
    rest = rest.where(F.size("figures") >= F.size("years"))
    value = amount_pdf(F.replace(F.try_element_at("figures", F.lit(-1)), F.lit("%"), F.lit("")))
    label = strip(F.regexp_replace(F.regexp_extract("line", rf"^(.*?)(?:{dims.TEXT_FIGURE})", 1), r"[\s(]+$", ""))
    label = strip(F.regexp_replace(F.lower(label), r"\s*\(times?\)?", ""))
    rest = rest.select("doc_id", "n", "block", value.alias("value"), label.alias("label")).where("value is not null")
    chain, low = F, F.col("label")
    for word, field in [*dims.TEXT_PERCENTAGES, *dims.TEXT_RATIOS]:
        chain = chain.when(low.contains(word), F.lit(field))
    for field, words in dims.TEXT_AMOUNTS:
        chain = chain.when(reduce(lambda a, w: a | low.contains(w), words[1:], low.contains(words[0])), F.lit(field))
    amount = F.col("field").isin(*(f for f, _ in dims.TEXT_AMOUNTS))
    rest = rest.withColumn("field", chain.otherwise(F.lit(None).cast("string"))).withColumn("value", F.when(amount, F.round(F.col("value") * detect_unit(F.col("block")), 2)).otherwise(F.col("value")))
    fields = ["revenue_cr", "pat_cr", "interest_coverage", "ebitda_margin_pct", "total_ratio", "net_ratio"]
    got = rest.groupBy("doc_id").agg(*(F.min_by("value", F.when(F.col("field") == f, F.col("n"))).alias(f) for f in fields))
    out = years.select("doc_id", year_from_header(F.try_element_at("years", F.lit(-1))).alias("fiscal_year")).join(got, "doc_id", "left")
    out = out.withColumn("ebitda_cr", F.when(F.col("revenue_cr") > 0, F.round(F.col("revenue_cr") * F.col("ebitda_margin_pct") / 100, 2)))
    debts = {into: F.when(F.col("ebitda_cr") > 0, F.round(F.col(ratio) * F.col("ebitda_cr"), 2)) for into, ratio in (("total_debt_cr", "total_ratio"), ("net_debt_cr", "net_ratio"))}
    return out.withColumns(debts).drop("total_ratio", "net_ratio")


def derive_metrics(df: DataFrame) -> DataFrame:
    """Net debt, EBITDA margin and leverage where they are missing."""
    net = F.coalesce("net_debt_cr", F.col("total_debt_cr") - F.col("cash_cr"))
    margin = F.when(truthy(F.col("revenue_cr")) & truthy(F.col("ebitda_cr")) & (F.col("revenue_cr") > 0), F.round(F.try_divide("ebitda_cr", "revenue_cr") * 100, 2))
    leverage = F.when(F.col("ebitda_cr") > 0, F.round(F.try_divide(net, F.col("ebitda_cr")), 2))
    have = {c: F.col(c) if c in df.columns else F.lit(None).cast("double") for c in ("ebitda_margin_pct", "net_debt_ebitda")}
    return df.withColumns({"ebitda_margin_pct": F.coalesce(have["ebitda_margin_pct"], margin), "net_debt_ebitda": F.coalesce(have["net_debt_ebitda"], leverage), "net_debt_cr": net})


def extract_financials(pages: DataFrame) -> DataFrame:
    """One row per document: from tables, else the text table, else plain text where revenue or EBITDA is missing; derived; scored."""
    texts = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("p")).select("doc_id", F.array_join(F.transform("p", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    out = texts.withColumn("plain", extract_from_text(F.col("text"))).select("doc_id", "plain")
    tables, block = process_tables(pages), extract_text_table(texts)
    out = out.join(tables.select("doc_id", F.struct(*(c for c in tables.columns if c != "doc_id")).alias("t")), "doc_id", "left")
    out = out.join(block.select("doc_id", F.struct(*(c for c in block.columns if c != "doc_id")).alias("b")), "doc_id", "left")

    def first(field: str) -> Column:
        have = [F.col(s)[field] for s, names in (("t", tables.columns), ("b", block.columns)) if field in names]
        return F.coalesce(*have) if have else F.lit(None).cast("double")

    names = [*FIELDS, "ebitda_margin_pct"]
    out = out.select("doc_id", "plain", first("fiscal_year").alias("fiscal_year"), *(first(f).alias(f) for f in names))
    thin = F.col("revenue_cr").isNull() | F.col("ebitda_cr").isNull()
    out = out.select("doc_id", "fiscal_year", *(F.coalesce(F.col(f), F.when(thin, F.col("plain")[f])).alias(f) if f in dims.TEXT_WORDS else F.col(f) for f in names))
    out = derive_metrics(out)
    return out.withColumn("confidence", confidence_generic(*(F.col(c) for c in ("revenue_cr", "ebitda_cr", "pat_cr", "total_debt_cr", "cash_cr", "capex_cr"))))


def extract_capex_plans(pages: DataFrame) -> DataFrame:
    """doc_id, amount_cr, timeframe_years, description, source_text of every plan in a forward-looking sentence."""
    s = pages.select("doc_id", "page_no", "text", F.posexplode(split_sentences(F.coalesce("text", F.lit("")))).alias("n", "sentence"))
    s = s.where(F.col("sentence").rlike(dims.CAPEX_AHEAD))
    figures, units = F.regexp_extract_all("sentence", F.lit(dims.CAPEX), F.lit(1)), F.regexp_extract_all("sentence", F.lit(dims.CAPEX), F.lit(2))
    s = s.select("doc_id", "text", "sentence", F.explode(F.arrays_zip(figures.alias("figure"), units.alias("unit"))).alias("x"))
    value, unit = amount_pdf(F.col("x.figure")), none_if_empty(F.col("x.unit"))
    amount = F.when(unit.isNotNull(), apply_unit(value, unit)).otherwise(value * detect_unit(F.col("text")))
    span = none_if_empty(F.regexp_extract("sentence", dims.CAPEX_SPAN, 2)).cast("int")
    ahead = none_if_empty(F.regexp_extract("sentence", dims.CAPEX_NEXT, 1)).cast("int")
    out = s.select("doc_id", F.round(amount, 2).alias("amount_cr"), F.coalesce(span, ahead).alias("timeframe_years"), F.substring("sentence", 1, 200).alias("description"), F.substring("sentence", 1, 500).alias("source_text"))
    return out.where("amount_cr is not null")


def detect_unit_record(rec: Column) -> Column:
    """Multiple of a crore: from a unit field, else from the size of revenue, else lakhs."""

    def of(v: Column) -> Column:
        return F.when(v.contains("cr"), 1.0).when(v.contains("lakh") | v.contains("lac"), 0.01).when(v.contains("million"), 0.1)

    said = F.coalesce(*(of(F.lower(rec[n])) for n in dims.UNIT_FIELDS))
    revenue = F.coalesce(*(amount_bse(rec[n]) for n in dims.UNIT_REVENUE_FIELDS))
    return F.coalesce(said, bind(revenue, lambda r: F.when(r > 100_000, 0.01).when(r.isNotNull(), 1.0)), F.lit(0.01))


def _once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Columns that are worked out once a row: a generator keeps the optimizer from repeating them wherever they are used."""
    return df.select(*keep, F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("_x")).select(*keep, "_x.*")


def top_n_years(df: DataFrame, key: str, n: int = 2) -> DataFrame:
    """The n newest years of each key; a missing year is the oldest, ties go by seq."""
    w = Window.partitionBy(key).orderBy(F.coalesce("fiscal_year", F.lit(0)).desc(), "seq")
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def annual_results(records: DataFrame) -> DataFrame:
    """scrip_cd, seq and figures in crores of the two newest annual records; records without a type count as annual.

    records: scrip_cd, seq, rec (map of text).
    """

    def filled(name: str) -> Column:
        v = F.col("rec")[name]
        return F.when(~v.rlike(dims.NO_VALUE), v)

    texts = _once(records, "scrip_cd", "seq", unit=detect_unit_record(F.col("rec")), **{k: F.coalesce(*map(filled, v)) for k, v in dims.RESULT_FIELDS.items()})
    kind, end = F.upper(F.coalesce("period", F.lit(""))), F.coalesce("end", F.lit(""))
    months = F.when(F.col("months").rlike("^[0-9]+$"), F.col("months").cast("int")).otherwise(0)
    annual = kind.isin("A", "ANNUAL", "YEARLY") | (months == 12) | (end.rlike(dims.YEAR_END) & (months >= 9)) | (kind == "")
    names = [k for k in dims.RESULT_FIELDS if k not in ("period", "end", "months")]
    year = none_if_empty(F.regexp_extract(end, dims.YEAR, 1)).cast("int")
    r = _once(texts.where(annual), "scrip_cd", "seq", fiscal_year=year, **{k: amount_bse(F.col(k)) * F.col("unit") for k in names})
    ebitda = F.coalesce(F.col("operating_profit"), F.col("pbt") + F.col("depreciation") + F.col("finance_cost"), F.col("pbt") + F.col("depreciation"))
    r = r.withColumns({"ebitda": ebitda, "net_debt": F.col("total_debt") - F.col("cash")})
    r = r.select(
        "scrip_cd", "seq", "fiscal_year", F.col("revenue").alias("revenue_cr"), F.col("ebitda").alias("ebitda_cr"),
        F.when(F.col("revenue") > 0, F.round(F.try_divide("ebitda", "revenue") * 100, 2)).alias("ebitda_margin_pct"), F.col("pat").alias("pat_cr"),
        F.col("total_debt").alias("total_debt_cr"), F.col("cash").alias("cash_cr"), F.col("net_debt").alias("net_debt_cr"), F.col("capex").alias("capex_cr"),
        F.when(F.col("finance_cost") > 0, F.round(F.try_divide("ebitda", "finance_cost"), 2)).alias("interest_coverage"),
        F.when(F.col("ebitda") > 0, F.round(F.try_divide("net_debt", "ebitda"), 2)).alias("net_debt_ebitda"),
    )
    data = F.coalesce(*(F.col(c) for c in r.columns if c not in ("scrip_cd", "seq", "fiscal_year")))
    return top_n_years(r.where(data.isNotNull()), "scrip_cd")


def statement_financials(long: DataFrame, years: int = 2) -> DataFrame:
    """symbol, fiscal_year and figures in crores of the newest periods, taken before the test for data.

    long: symbol, statement, item, period_end, value. Missing items are null.
    """
    picks = [F.max(F.when((F.col("statement") == s) & (F.col("item") == item) & ~F.isnan("value"), F.col("value") * 1e-7)).alias(f"{k}_{i}") for k, (s, items) in dims.STATEMENT_ITEMS.items() for i, item in enumerate(items)]
    p = long.groupBy("symbol", "period_end").agg(*picks)
    p = p.select("symbol", "period_end", *(F.coalesce(*(F.col(f"{k}_{i}") for i in range(len(items)))).alias(k) for k, (_, items) in dims.STATEMENT_ITEMS.items()))
    p = p.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("period_end")))).where(F.col("_n") <= years)
    p = p.withColumns({"ebitda": F.coalesce("ebitda", F.col("ebit") + F.col("depreciation")), "net_debt": F.coalesce("net_debt", F.col("total_debt") - F.col("cash"))})
    p = p.where(F.coalesce("revenue", "ebitda", "pat", "total_debt").isNotNull())
    two = {f"{c}_cr": F.round(F.col(c), 2) for c in ("revenue", "ebitda", "pat", "total_debt", "cash", "net_debt")}
    return p.select(
        "symbol", F.year("period_end").alias("fiscal_year"), *(v.alias(k) for k, v in two.items()), F.round(F.abs("capex"), 2).alias("capex_cr"),
        F.when(F.col("revenue") > 0, F.round(F.try_divide("ebitda", "revenue") * 100, 2)).alias("ebitda_margin_pct"),
        F.when(F.col("ebitda") > 0, F.round(F.try_divide("net_debt", "ebitda"), 2)).alias("net_debt_ebitda"),
    )


def parse_brief_financials(pages: DataFrame) -> DataFrame:
    """doc_id, fiscal_year and figures of 'Brief financials' tables; the last value of a field wins, and revenue is required."""
    t = pages.select("doc_id", "page_no", F.posexplode("tables").alias("table_no", "table"))
    head = F.expr("filter(transform(table, (r, i) -> if(contains(lower(array_join(transform(r, c -> coalesce(c, '')), ' ')), 'brief financials'), i, null)), i -> i is not null)")
    t = t.withColumn("head", F.try_element_at(head, F.lit(1))).where("head is not null")
    cells = t.select("doc_id", "page_no", "table_no", "table", "head", F.posexplode(_cell(F.col("table"), F.col("head"))).alias("col", "cell"))
    low = F.lower(strip(F.coalesce("cell", F.lit(""))))
    years = cells.where(~low.rlike(dims.BRIEF_PARTIAL)).withColumn("fiscal_year", fiscal_year_care(strip(F.coalesce("cell", F.lit(""))))).where("fiscal_year is not null")
    rows = years.select("doc_id", "page_no", "table_no", "head", "col", "fiscal_year", F.posexplode("table").alias("row_no", "cells")).where("row_no > head")
    label = F.try_element_at(F.filter(F.transform(F.slice("cells", 1, 3), lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: c != ""), F.lit(1))
    rows = rows.select("doc_id", "fiscal_year", F.struct("page_no", "table_no", "row_no", "col").alias("at"), map_label_care(label).alias("field"), amount_care(_cell(F.col("cells"), F.col("col"))).alias("value")).where("field is not null and value is not null")
    fields = [f for f, _, _ in dims.BRIEF_RULES]
    out = rows.groupBy("doc_id", "fiscal_year").agg(*(F.max_by("value", F.when(F.col("field") == f, F.col("at"))).alias(f) for f in fields))
    out = out.where(truthy(F.col("revenue_cr"))).withColumn("ebitda_margin_pct", F.when(truthy(F.col("ebitda_cr")), F.round(F.try_divide("ebitda_cr", "revenue_cr") * 100, 2)))
    keys = [F.col(c) for c in ("revenue_cr", "ebitda_cr", "pat_cr", "interest_coverage")]
    return out.withColumns({"extraction_confidence": confidence_care(*keys), "data_source": F.lit(dims.SOURCES["care"][0])})


def parse_rating_table(pages: DataFrame) -> DataFrame:
    """doc_id, row_no and the instruments of the first facilities table with rows on page 1."""
    t = pages.where("page_no = 1").select("doc_id", F.posexplode("tables").alias("table_no", "table")).where(F.size("table") >= 2)
    t = t.where(F.exists(F.transform(F.col("table")[0], lambda c: F.lower(F.coalesce(c, F.lit("")))), lambda c: c.contains("facilities") | c.contains("instruments")))
    rows = t.select("doc_id", "table_no", F.posexplode("table").alias("row_no", "cells")).where("row_no > 0")
    rows = rows.select("doc_id", "table_no", "row_no", *(strip(F.coalesce(F.try_element_at("cells", F.lit(i + 1)), F.lit(""))).alias(c) for i, c in enumerate(("instrument_name", "amount", "raw", "rating_action"))))
    rows = rows.where((F.col("raw") != "") & ~F.lower("instrument_name").startswith("facilities"))
    rows = rows.withColumn("first", F.min("table_no").over(Window.partitionBy("doc_id"))).where("table_no = first")
    rating = normalize_rating(strip(F.substring_index("raw", " / ", 1)))
    return rows.select("doc_id", "row_no", "instrument_name", instrument_type_by_name(F.col("instrument_name")).alias("instrument_type"), amount_digits(F.col("amount")).alias("rated_amount_cr"), rating["base"].alias("rating_symbol"), rating["grade"].alias("rating_grade"), rating["outlook"].alias("outlook"), "rating_action")


def best_instrument(instruments: DataFrame) -> DataFrame:
    """Of each document the instrument of least grade, the first of ties."""
    row = F.struct(*(c for c in instruments.columns if c != "doc_id"))
    return instruments.where("rating_grade is not null").groupBy("doc_id").agg(F.min_by(row, F.struct("rating_grade", "row_no")).alias("r")).select("doc_id", "r.*")


def extract_release_date(text: Column) -> Column:
    """The first 'Month d, yyyy', as text."""
    return none_if_empty(F.regexp_extract(text, rf"(?i)({dims.MONTHS})\s+\d{{1,2}},?\s+\d{{4}}", 0))


def extract_industry(pages: DataFrame) -> DataFrame:
    """doc_id, industry: the first filled cell below the header of the first table on a page about industry classification."""
    p = pages.where(F.lower(F.coalesce("text", F.lit(""))).contains("industry classification"))
    rows = p.select("doc_id", "page_no", F.posexplode("tables").alias("table_no", "table"))
    head = F.expr("filter(transform(table, (r, i) -> if(contains(lower(array_join(transform(r, c -> coalesce(c, '')), ' ')), 'industry'), i, null)), i -> i is not null)")
    below = F.try_element_at("table", (F.try_element_at(head, F.lit(1)) + 2).cast("int"))
    value = F.try_element_at(F.filter(F.transform(below, lambda c: strip(F.coalesce(c, F.lit("")))), lambda c: ~F.lower(c).isin("", "none")), F.lit(1))
    return rows.select("doc_id", F.struct("page_no", "table_no").alias("at"), value.alias("industry")).where("industry is not null").groupBy("doc_id").agg(F.min_by("industry", "at").alias("industry"))


def parse_kfi(cells: DataFrame, lender: bool = False) -> DataFrame:
    """doc_id, fiscal_year and figures of key-indicator tables in web pages.

    cells: doc_id, table_no, row_no, cells. Year columns are looked for from the third on in the first two rows, a year's first place
    counts and a column's later row; for each year and field the first value counts.
    """
    head = cells.where("row_no < 2").select("doc_id", "table_no", "row_no", F.posexplode("cells").alias("col", "cell")).where("col >= 2")
    years = head.withColumn("fiscal_year", year_header_crisil(F.coalesce("cell", F.lit("")))).where("fiscal_year is not null")
    years = years.groupBy("doc_id", "table_no", "fiscal_year").agg(F.min(F.struct("row_no", "col")).alias("at"))
    years = years.groupBy("doc_id", "table_no", F.col("at.col").alias("col")).agg(F.max_by("fiscal_year", "at.row_no").alias("fiscal_year"))
    rows = cells.where("row_no > 0 and size(cells) > 2").select("doc_id", "table_no", "row_no", map_label_page(F.col("cells")[0], lender).alias("field"), F.posexplode("cells").alias("col", "cell")).where("field is not null")
    vals = rows.join(years, ["doc_id", "table_no", "col"]).withColumn("value", amount_crisil(F.coalesce("cell", F.lit("")))).where("value is not null")
    fields = sorted({f for _, f in (dims.LENDER_LABELS if lender else dims.PAGE_LABELS)} & {*FIELDS, "ebitda_margin_pct"})
    return vals.groupBy("doc_id", "fiscal_year").agg(*(F.min_by("value", F.when(F.col("field") == f, F.struct("table_no", "row_no", "col"))).alias(f) for f in fields))


def tag_source(df: DataFrame, source: str) -> DataFrame:
    """data_source and, where it isn't computed, extraction_confidence of a source."""
    name, confidence = dims.SOURCES[source]
    out = df.withColumn("data_source", F.lit(name))
    return out if confidence is None else out.withColumn("extraction_confidence", F.lit(confidence))


def has_figures(df: DataFrame) -> DataFrame:
    """Rows with a revenue, EBITDA or profit other than zero."""
    return df.where(truthy(F.col("revenue_cr")) | truthy(F.col("ebitda_cr")) | truthy(F.col("pat_cr")))

