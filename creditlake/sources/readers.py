"""Readers of landed raw records.

A file is one answer of a source, so a reader's unit of work is a file: right for many small landings. With ``lines`` each line of a
file is an answer, and large files are split over tasks; with ``size`` an answer is one very large list, read by ranges of so many bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake import dims
from creditlake.functions.names import none_if_empty, normalize_name_ws, strip
from creditlake.functions.numbers import amount_digits, amount_plain, number
from creditlake.functions.ratings import instrument_type_by_symbol, normalize_rating
from creditlake.sources.arrays import read_elements

MAP = "map<string,string>"


def _text(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=not lines)


def first_spelling(rec: Column, names: list[str]) -> Column:
    """The first value that isn't null or empty."""
    return F.coalesce(*(none_if_empty(rec[n]) for n in names))


def read_embedded_array(pages: DataFrame, var: str = "RatingBaseModel") -> DataFrame:
    """The columns of pages but html, and pos and rec (a map) of each object in the page's ``var x = [...];``."""
    rest = [c for c in pages.columns if c != "html"]
    found = F.regexp_extract("html", rf"(?s)var\s+{var}\s*=\s*(\[.*?\]);", 1)
    return pages.select(*rest, F.posexplode(F.from_json(none_if_empty(found), f"array<{MAP}>")).alias("pos", "rec"))


def read_embedded_detail(pages: DataFrame, var: str = "RatingDetails") -> DataFrame:
    """The same for the instruments of the page's ``var x = {...};``; broken JSON gives no rows."""
    rest = [c for c in pages.columns if c != "html"]
    found = F.regexp_extract("html", rf"(?s)var\s+{var}\s*=\s*(\{{.*?\}});\s*\n", 1)
    parsed = F.from_json(none_if_empty(found), f"LstRatingInstrumentData array<{MAP}>")
    return pages.select(*rest, F.posexplode(parsed["LstRatingInstrumentData"]).alias("pos", "rec"))


def read_company_universe(search: DataFrame) -> DataFrame:
    """id, name of each company in search answers (seq, id, label), both split at #; the last name of an id counts."""
    x = search.select("seq", F.posexplode(F.arrays_zip(F.split("id", "#").alias("id"), F.split("label", "#").alias("name"))).alias("n", "x"))
    x = x.select(F.struct("seq", "n").alias("at"), strip(F.col("x.id")).alias("id"), strip(F.col("x.name")).alias("name")).where(F.col("id").rlike("^[0-9]+$") & (F.col("name") != ""))
    return x.groupBy("id").agg(F.max_by("name", "at").alias("name"))


def read_suggest(spark: SparkSession, path: str, lines: bool = False, limit: int | None = None) -> DataFrame:
    """value of each entry of a JSON array, without empty ones; all or so many of them for a trial run."""
    out = _text(spark, path, lines).select(F.explode(F.from_json("value", "array<struct<value:string>>")["value"]).alias("value")).where(F.coalesce("value", F.lit("")) != "")
    return out if limit is None else out.limit(limit)


def read_listing_docs(spark: SparkSession, path: str, lines: bool = False, size: int | None = None) -> DataFrame:
    """Documents of listing pages; rows without a name or file are dropped."""
    one = "companyName string, companyCode string, ratingFileName string, ratingDate string, prId string"
    if size is not None:
        d = read_elements(spark, path, ["docs"], size).select(F.from_json("value", one).alias("d"))
    else:
        d = spark.read.schema(f"docs array<struct<{one.replace(' string', ':string')}>>").json(path, multiLine=not lines).select(F.explode("docs").alias("d"))
    return d.select("d.*").where((F.coalesce("companyName", F.lit("")) != "") & (F.coalesce("ratingFileName", F.lit("")) != ""))


def read_issuers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Issuer documents, each an object or an array of which the first counts; blank names are dropped."""
    one = "issuer_id:bigint,name:string,sector:string,subSector:string,effectiveDate:string,ratingsList:array<struct<rating:string,instrumentName:string,amount:string>>"
    t = _text(spark, path, lines).select(strip(F.col("value")).alias("v"))
    many, single = F.from_json("v", f"array<struct<{one}>>"), F.from_json("v", f"struct<{one}>")
    parsed = F.when(F.col("v").startswith("["), F.try_element_at(many, F.lit(1))).otherwise(single)
    return t.select(parsed.alias("i")).select("i.*").where(strip(F.coalesce("name", F.lit(""))) != "")


def _bare_or_wrapped(spark: SparkSession, path: str, wrappers: list[str], lines: bool, size: int | None = None) -> DataFrame:
    """pos, rec of records in a JSON list that is bare or under the first wrapper key that has one; pos is a place in the file if read by ranges."""
    if size is not None:
        return read_elements(spark, path, wrappers, size).select(F.col("at").alias("pos"), F.from_json("value", MAP).alias("rec"))
    t = _text(spark, path, lines).select(F.col("value").alias("v"))
    wrapped = F.from_json("v", MAP)
    found = F.from_json(F.when(strip(F.col("v")).startswith("["), F.col("v")).otherwise(F.coalesce(*(none_if_empty(wrapped[w]) for w in wrappers))), f"array<{MAP}>")
    return t.select(F.posexplode(found).alias("pos", "rec"))


def read_press_releases(spark: SparkSession, path: str, lines: bool = False, size: int | None = None) -> DataFrame:
    """pos, company, file_url, title, published of press releases, bare or under ``data``."""
    r = _bare_or_wrapped(spark, path, ["data"], lines, size)
    return r.select("pos", F.col("rec")["CompanyName"].alias("company"), F.col("rec")["FileURL"].alias("file_url"), F.col("rec")["FileTitle"].alias("title"), F.col("rec")["PublishedDate"].alias("published"))


# Fixed: keys under which exchanges wrap their lists, in order.
SCRIP_WRAPPERS = ["Table", "table", "data", "Data", "Scrips", "scrips", "result"]
RESULT_WRAPPERS = ["Table", "table", "data", "Data", "result", "Result", "Results"]
# Fixed: spellings of scrip fields, in order.
SCRIP_FIELDS = {
    "code": ["SCRIP_CD", "scripCd", "ScripCd", "scrip_cd"], "symbol": ["SCRIP_ID", "scripId", "ScripId", "symbol"],
    "name": ["SCRIP_NAME", "scripName", "ScripName", "companyName"], "isin": ["ISIN_NUMBER", "isinNo", "ISIN", "isin"],
}


def scrip_columns(raw: DataFrame) -> DataFrame:
    """pos, code, symbol, name, isin of scrip records (pos, rec)."""
    return raw.select("pos", *(strip(F.coalesce(first_spelling(F.col("rec"), v), F.lit(""))).alias(k) for k, v in SCRIP_FIELDS.items()))


def read_scrips(spark: SparkSession, path: str, lines: bool = False, size: int | None = None) -> DataFrame:
    return scrip_columns(_bare_or_wrapped(spark, path, SCRIP_WRAPPERS, lines, size))


def read_results(spark: SparkSession, path: str, lines: bool = False, size: int | None = None) -> DataFrame:
    """pos, rec of result records, bare or wrapped."""
    return _bare_or_wrapped(spark, path, RESULT_WRAPPERS, lines, size)


def read_equity_csv(spark: SparkSession, path: str) -> DataFrame:
    """symbol, name, isin, name_norm; columns are found by words in their trimmed headers."""
    d = spark.read.csv(path, header=True)

    def find(*words: str) -> Column:
        hit = next((c for c in d.columns if all(w in c.strip().lower() for w in words)), None)
        return strip(F.coalesce(d[f"`{hit}`"], F.lit(""))) if hit else F.lit("")

    name = find("company") if any("company" in c.lower() for c in d.columns) else find("name")
    out = d.select(find("symbol").alias("symbol"), name.alias("name"), F.upper(find("isin")).alias("isin"))
    return out.where("symbol <> ''").withColumn("name_norm", normalize_name_ws(F.col("name")))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("symbol", "statement", "item", F.col("period_end").cast("date"), F.col("value").cast("double"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", "page_no", "text", "tables")


def parse_notes(raw: DataFrame) -> DataFrame:
    """company_id, note of a JSON map; blank notes are dropped. raw: value."""
    n = raw.select(F.explode(F.from_json("value", MAP)).alias("company_id", "note"))
    return n.select(F.col("company_id").try_cast("long").alias("company_id"), strip(F.col("note")).alias("note")).where("note <> ''")


def import_notes(spark: SparkSession, path: str, existing: DataFrame) -> DataFrame:
    """Notes of a JSON file, used only while the table is empty."""
    return existing if existing.limit(1).count() else parse_notes(_text(spark, path))


def parse_listing_record(raw: DataFrame) -> DataFrame:
    """Listing records (rec) as columns, by the first spelling that is filled, with the rating normalised."""
    f = {k: first_spelling(F.col("rec"), v) for k, v in dims.LISTING_FIELDS.items()}
    rating = normalize_rating(F.coalesce(f["raw_rating"], F.lit("")))
    texts = {k: strip(F.coalesce(f[k], F.lit(""))) for k in ("company_name", "raw_rating", "sector", "sub_sector", "instrument")}
    rest = [c for c in raw.columns if c != "rec"]
    return raw.select(
        *rest, *(v.alias(k) for k, v in texts.items()), rating["base"].alias("rating_base"), rating["grade"].alias("rating_grade"), rating["outlook"].alias("outlook"),
        *(strip(f[k]).alias(k) for k in ("rating_date", "rationale_id", "company_key")), amount_digits(f["amount"]).alias("rated_amount_cr"),
    )


def parse_detail_records(raw: DataFrame, key: str = "company_id") -> DataFrame:
    """Instruments of a company's page (key, pos, rec) that have a grade, numbered in order."""
    from pyspark.sql.window import Window

    rec = F.col("rec")
    part = {k: strip(F.coalesce(rec[k], F.lit(""))) for k in ("Long", "LongOutlook", "Instrument1", "Instrument2", "Instrument3", "SectorName", "SubSectorName")}
    whole = strip(F.concat_ws(" ", part["Long"], none_if_empty(part["LongOutlook"])))
    names = F.array_join(F.filter(F.array(part["Instrument1"], part["Instrument2"], part["Instrument3"]), lambda x: x != ""), " / ")
    rating = normalize_rating(whole)
    r = raw.select(
        key, "pos", whole.alias("raw_rating"), rating["grade"].alias("rating_grade"), rating["outlook"].alias("outlook"), names.alias("instrument"),
        F.substring(F.coalesce(none_if_empty(rec["RatingDate"]), none_if_empty(rec["RatingDateString"])), 1, 10).alias("rating_date"), part["SectorName"].alias("sector"),
        part["SubSectorName"].alias("sub_sector"), F.nullif(number(strip(F.coalesce(none_if_empty(rec["RatingAmount"]), rec["RatedAmount"]))), F.lit(0.0)).alias("rated_amount_cr"),
    ).where("rating_grade is not null")
    n = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    return r.withColumn("source_id", F.concat_ws("_", F.col(key).cast("string"), n.cast("string")))


def parse_issuer_ratings(issuers: DataFrame) -> DataFrame:
    """One row for each rating of an issuer; 'symbol / outlook' is cut once."""
    x = issuers.select("issuer_id", "name", "sector", "subSector", "effectiveDate", F.posexplode("ratingsList").alias("idx", "r"))
    raw = strip(F.coalesce(F.col("r.rating"), F.lit("")))
    parts = F.split(raw, " / ", 2)
    symbol, said = strip(parts[0]), strip(F.try_element_at(parts, F.lit(2)))
    rating = normalize_rating(symbol)
    return x.select(
        "issuer_id", "name", "idx", F.coalesce(rating["base"], symbol).alias("rating_symbol"), rating["grade"].alias("rating_grade"), F.coalesce(none_if_empty(said), rating["outlook"]).alias("outlook"),
        F.col("r.instrumentName").alias("instrument_name"), instrument_type_by_symbol(F.col("r.instrumentName"), symbol).alias("instrument_type"), amount_plain(F.col("r.amount")).alias("rated_amount_cr"),
        F.concat_ws("_", F.col("issuer_id").cast("string"), F.col("idx").cast("string")).alias("source_id"), "sector", F.col("subSector").alias("sub_sector"), F.col("effectiveDate").alias("rating_date"),
    )
