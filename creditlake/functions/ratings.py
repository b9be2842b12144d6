"""Rating symbols, grades and outlooks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditlake import dims
from creditlake.functions.names import none_if_empty, strip

_SYMBOL = r"(?i)(?<![A-Za-z0-9])(" + "|".join(re.escape(s) for s in sorted(dims.SYMBOLS, key=len, reverse=True)) + r")(?![A-Za-z0-9])"


def extract_outlook(text: Column) -> Column:
    """Label of the first pattern, in list order, that occurs; '' if none does."""
    chain = F
    for pattern, label in dims.OUTLOOKS:
        chain = chain.when(text.rlike("(?i)" + pattern), F.lit(label))
    return chain.otherwise(F.lit(""))


def _symbol(segment: Column) -> Column:
    """The symbol in one segment of a rating: without prefixes, parentheses and actions, or else with parentheses."""
    bare = strip(F.regexp_replace(strip(segment), "(?i)^(?:" + "|".join(dims.AGENCY_PREFIXES) + ")+", ""))
    plain = strip(F.regexp_replace(bare, r"\([^)]*\)", ""))
    plain = strip(F.regexp_replace(plain, rf"(?id)\b({dims.ACTION_WORDS})\b.*", ""))
    plain = F.regexp_replace(plain, r"[^A-Za-z0-9+\-]", " ")
    return F.upper(F.coalesce(none_if_empty(F.regexp_extract(plain, _SYMBOL, 1)), none_if_empty(F.regexp_extract(bare, _SYMBOL, 1))))


def grade_of(symbol: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in dims.GRADES.items() for x in pair)), F.coalesce(symbol, F.lit("")))


def normalize_rating(raw: Column) -> Column:
    """struct(base, grade, outlook): the first segment between commas or semicolons that has a grade, the outlook of the whole."""
    base = F.try_element_at(F.array_compact(F.transform(F.split(strip(raw), "[,;]"), _symbol)), F.lit(1))
    return F.struct(base.alias("base"), grade_of(base).alias("grade"), F.coalesce(extract_outlook(raw), F.lit("")).alias("outlook"))


def with_rating(df: DataFrame, raw: str, into: str = "rating") -> DataFrame:
    """df with the normalised rating of each row; texts repeat, so each distinct one is worked on once and joined back."""
    known = df.select(F.col(raw).alias("_raw")).distinct().withColumn(into, normalize_rating(F.col("_raw")))
    return df.join(known, df[raw].eqNullSafe(known["_raw"]), "left").drop("_raw")


def grade_label(grade: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for s, g in dims.GRADES.items() for x in (g, s)))
    return F.coalesce(F.try_element_at(labels, F.coalesce(grade.cast("int"), F.lit(0))), F.concat(F.lit("Grade "), grade.cast("string")))


def grade_band(grade: Column) -> Column:
    """Number of the band, from 1; null outside of all."""
    chain = F
    for n, (low, high) in enumerate(dims.BANDS, 1):
        chain = chain.when(grade.between(low, high), F.lit(n))
    return chain.otherwise(F.lit(None).cast("int"))


def grade_preset(name: str) -> tuple[int, int]:
    """Grade range of a preset."""
    return dims.PRESETS[name]


def instrument_type_by_symbol(name: Column, symbol: Column) -> Column:
    """ST for commercial paper, short-term names and symbols A1 to A4, otherwise LT."""
    short = F.coalesce(F.lower(name), F.lit("")).rlike(dims.SHORT_TERM_NAMES) | F.coalesce(F.upper(symbol), F.lit("")).rlike(dims.SHORT_TERM_SYMBOLS)
    return F.when(short, "ST").otherwise("LT")


def instrument_type_by_name(name: Column) -> Column:
    """LT/ST where both terms are named, ST for short term or commercial paper, otherwise LT."""
    n = F.coalesce(F.lower(name), F.lit(""))
    return F.when(n.contains("short") & n.contains("long"), "LT/ST").when(n.contains("short") | n.contains("commercial paper"), "ST").otherwise("LT")


def parse_suggest(value: Column) -> Column:
    """struct of name, raw_rating, grade, outlook, rating_date, action from 'Company:Action text'; a blank name gives null."""
    name = strip(F.substring_index(value, ":", 1))
    action = strip(F.regexp_replace(value, r"(?s)^[^:]*:", ""))
    found = strip(F.regexp_extract(action, dims.SUGGEST_RATING, 1))
    raw = strip(F.substring_index(found, "/", 1))
    said = F.initcap(none_if_empty(F.regexp_extract(action, dims.SUGGEST_OUTLOOK, 1)))
    slash = F.initcap(none_if_empty(strip(F.try_element_at(F.split(found, "/"), F.lit(2)))))
    date = none_if_empty(F.regexp_extract(action, dims.SUGGEST_DATE, 1))
    rating = normalize_rating(raw)
    row = F.struct(name.alias("company_name"), raw.alias("raw_rating"), rating["grade"].alias("rating_grade"), F.coalesce(said, slash, rating["outlook"]).alias("outlook"), date.alias("rating_date"), action.alias("action_text"))
    return F.when(value.contains(":") & (name != ""), row)
