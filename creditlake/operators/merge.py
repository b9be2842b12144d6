"""Write semantics: first, last and best wins, with the arrival order in an explicit column ``seq``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditlake.functions.names import none_if_empty, normalize_name, strip
from creditlake.sources.writers import staged

_ATTRIBUTES = ["cin", "isin", "bse_code", "nse_symbol", "is_listed"]


def assign_ids(new: DataFrame, order: list[str], start: int, into: str = "id") -> DataFrame:
    """Dense numbers after ``start`` in the order given: a range sort, a count for each partition, and offsets of partitions.

    Sorted rows are written once with their partition and place: a range sort that runs again draws other boundaries, and then the
    partitions wouldn't be those that were counted. One number a partition comes to the driver; no window without a key, so no single task.
    """
    p = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    p = p.withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    p = staged(p)
    counts = sorted((r["_part"], r["count"]) for r in p.groupBy("_part").count().collect())
    offsets, at = [], start
    for part, n in counts:
        offsets.append((part, at))
        at += n
    table = new.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    return p.join(F.broadcast(table), "_part").withColumn(into, F.col("_offset") + F.col("_place") + 1).drop("_part", "_place", "_offset")


def _last(c: str) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", -F.col("id"))))


def upsert_companies(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """By normalised name: the first spelling stays, each attribute is the last that isn't null; a new company has a null id.

    existing: companies, of which several can have one normalised name; they count as one, with the greatest id, and what several
    of them have is that of the least id. incoming: name, seq and any of the attributes.
    """
    have = [c for c in _ATTRIBUTES if c in incoming.columns]
    old = existing.select("id", "name", "name_normalized", *_ATTRIBUTES, F.lit(-1).cast("long").alias("seq"))
    new = incoming.select(F.lit(None).cast("long").alias("id"), "name", normalize_name(F.col("name")).alias("name_normalized"), *have, F.col("seq").cast("long"))
    both = old.unionByName(new, allowMissingColumns=True)
    out = both.groupBy("name_normalized").agg(F.max("id").alias("id"), F.min_by("name", F.struct("seq", "id")).alias("name"), *(_last(c).alias(c) for c in _ATTRIBUTES))
    return out.withColumn("is_listed", F.coalesce("is_listed", F.lit(0)))


def new_ratings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What incoming adds: the first of each company, agency and source_id that existing doesn't have, and every row without a source_id.

    incoming has ``seq`` and no id; rows without a key skip the exchange.
    """
    keys = ["company_id", "agency", "source_id"]
    keyed = F.coalesce(F.col("source_id"), F.lit("")) != ""
    payload = [c for c in incoming.columns if c not in (*keys, "seq")]
    first = incoming.where(keyed).groupBy(*keys).agg(F.min_by(F.struct("seq", *payload), "seq").alias("_r")).select(*keys, "_r.*")
    fresh = first.join(existing.where(keyed).select(*keys), keys, "left_anti")
    return fresh.unionByName(incoming.where(~keyed), allowMissingColumns=True)


def insert_ratings(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing and what is new."""
    return existing.unionByName(new_ratings(existing, incoming), allowMissingColumns=True)


def union_ratings(*agencies: DataFrame) -> DataFrame:
    """Parsed rows of several agencies as one set, by column name; a column that one lacks is null there."""
    out = agencies[0]
    for a in agencies[1:]:
        out = out.unionByName(a, allowMissingColumns=True)
    return out


def merge_financials(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Per company, year and source the row of highest confidence, the earlier of ties; rows without a year or source all stay.

    A row that replaces another is new: it keeps no id.
    """
    keys = ["company_id", "fiscal_year", "data_source"]
    old = existing.withColumn("seq", F.lit(-1).cast("long"))
    both = old.unionByName(incoming.withColumn("seq", F.col("seq").cast("long")), allowMissingColumns=True)
    keyed = (F.coalesce("fiscal_year", F.lit(0)) != 0) & (F.coalesce("data_source", F.lit("")) != "")
    payload = [c for c in both.columns if c not in keys]
    best = F.struct(F.coalesce("extraction_confidence", F.lit(0.0)), -F.col("seq"), -F.coalesce("id", F.lit(0)))
    won = both.where(keyed).groupBy(*keys).agg(F.max_by(F.struct(*payload), best).alias("_r")).select(*keys, "_r.*")
    return won.unionByName(both.where(~keyed).select(*won.columns))


def override_sector(ratings: DataFrame, overrides: DataFrame) -> DataFrame:
    """All ratings of a company get its override, trimmed."""
    o = overrides.select("company_id", strip(F.coalesce("sector", F.lit(""))).alias("_sector"))
    return ratings.join(o, "company_id", "left").withColumn("sector", F.coalesce("_sector", "sector")).drop("_sector").select(*ratings.columns)


def fill_missing_sector(ratings: DataFrame, derived: DataFrame, agency: str) -> DataFrame:
    """One agency's ratings without a sector get the one derived for the company."""
    d = derived.select("company_id", F.col("sector").alias("_sector"))
    empty = (F.col("agency") == agency) & none_if_empty(F.col("sector")).isNull() & none_if_empty(F.col("_sector")).isNotNull()
    return ratings.join(d, "company_id", "left").withColumn("sector", F.when(empty, F.col("_sector")).otherwise(F.col("sector"))).select(*ratings.columns)


def apply_note_edits(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Trimmed edits replace notes; a blank edit deletes."""
    e = edits.select("company_id", strip(F.coalesce("note", F.lit(""))).alias("_note"))
    out = notes.join(e, "company_id", "full").withColumn("note", F.coalesce("_note", "note"))
    return out.where(F.col("note") != "").select("company_id", "note")


def replace_notes(notes: DataFrame) -> DataFrame:
    """A full replacement, without blanks."""
    return notes.select("company_id", strip(F.col("note")).alias("note")).where(F.col("note") != "")


def mark_listed(companies: DataFrame, matches: DataFrame, exchange: str) -> DataFrame:
    """companies with is_listed set where matched. BSE: isin and code of the match first; NSE: own isin and code first.

    matches: company_id, ref_isin, ref_code.
    """
    m = companies.join(matches.withColumnRenamed("company_id", "id"), "id", "left")
    hit = F.col("ref_code").isNotNull() | F.col("ref_isin").isNotNull()
    own_isin, own_code = none_if_empty(F.col("isin")), none_if_empty(F.col("bse_code"))
    isin, code = none_if_empty(F.col("ref_isin")), none_if_empty(F.col("ref_code"))
    if exchange == "BSE":
        new = {"isin": F.coalesce(isin, own_isin), "bse_code": F.coalesce(code, own_code)}
    else:
        new = {"isin": own_isin, "bse_code": F.coalesce(own_code, code)}
    return m.select(*(F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.when(hit, 1).otherwise(F.col(c)).alias(c) if c == "is_listed" else F.col(c) for c in companies.columns))


def keep_first(df: DataFrame, keys: list[str], by: str = "id") -> DataFrame:
    """The row of least id for each key; null keys are one key."""
    w = Window.partitionBy(*keys).orderBy(by)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
