"""Numbers, units and fiscal years as they are written in sources."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditlake import dims
from creditlake.functions.names import bind, none_if_empty, strip

_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def number(text: Column) -> Column:
    """A double where the whole text is a plain number, otherwise null."""
    return bind(text, lambda t: F.when(t.rlike(_NUMBER), t.try_cast("double")))


def _in_brackets(text: Column) -> Column:
    return bind(text, lambda t: F.when(t.startswith("(") & t.endswith(")"), F.concat(F.lit("-"), F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t))


def amount_plain(text: Column) -> Column:
    """Commas cut, stripped."""
    return number(strip(F.replace(text, F.lit(","), F.lit(""))))


def amount_bse(text: Column) -> Column:
    """Commas cut; a trailing word, % or blanks cut; then brackets are a minus. What is a plain number already takes the short way."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double")).otherwise(number(_in_brackets(F.regexp_replace(strip(F.replace(text, F.lit(","), F.lit(""))), r"[A-Za-z%\s]+$", ""))))


def amount_pdf(text: Column) -> Column:
    """Commas and blanks cut; brackets are a minus; then a trailing word or % is cut."""
    c = F.replace(F.replace(strip(text), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    return number(F.regexp_replace(_in_brackets(c), "[A-Za-z%]+$", ""))


def amount_crisil(text: Column) -> Column:
    """Digits and dots only, the sign from brackets only; so a leading minus is lost."""
    t = strip(text)
    n = number(F.regexp_replace(t, "[^0-9.]", ""))
    return F.when(t.isin("", "-", "N/A", "NA", "Nil", "--"), None).otherwise(F.when(t.startswith("(") & t.endswith(")"), -n).otherwise(n))


def amount_care(text: Column) -> Column:
    """Commas and trailing asterisks cut; brackets aren't a minus but no number."""
    t = F.replace(strip(text), F.lit(","), F.lit(""))
    return F.when(t.isin("-", "--", "na", "n.a.", "n/a", ""), None).otherwise(number(strip(F.regexp_replace(t, r"\*+$", ""))))


def amount_digits(text: Column) -> Column:
    """Digits and dots only."""
    return number(F.regexp_replace(text, "[^0-9.]", ""))


def detect_unit(text: Column) -> Column:
    """Multiple of a crore that a block of text declares; 1 without a declaration."""
    t = F.lower(text)
    chain = F
    for pattern, multiple in dims.DECLARED_UNITS:
        chain = chain.when(t.rlike(pattern), multiple)
    return chain.otherwise(1.0)


def apply_unit(value: Column, unit: Column) -> Column:
    """Value in crores; an unknown or missing unit is a crore."""
    table = F.create_map(*(F.lit(x) for pair in dims.UNITS.items() for x in pair))
    return value * F.coalesce(F.try_element_at(table, F.coalesce(strip(F.lower(unit)), F.lit(""))), F.lit(1.0))


def year_from_header(text: Column) -> Column:
    """20yy as it is; FYyy is the year after; otherwise null."""
    full = none_if_empty(F.regexp_extract(text, dims.FULL_YEAR, 1)).cast("int")
    short = none_if_empty(F.regexp_extract(text, dims.SHORT_YEAR, 1)).cast("int")
    return F.coalesce(2000 + full, F.when(short < 50, 2000 + short + 1).otherwise(1900 + short + 1))


def year_columns(header: Column) -> Column:
    """Places (from 0) of the cells of a header that look like years, rightmost first."""
    return F.reverse(F.filter(F.transform(header, lambda c, i: F.when(c.rlike(dims.YEAR_LIKE), i)), lambda i: i.isNotNull()))


def year_header_crisil(text: Column) -> Column:
    """FYyyyy, Mar-yy or yyyy; two digits turn at 50; only 2000 to 2030."""
    n = F.coalesce(*(none_if_empty(F.regexp_extract(text, dims.PAGE_YEAR, i)).cast("int") for i in (1, 2, 3)))
    year = F.when(n >= 100, n).when(n < 50, 2000 + n).otherwise(1900 + n)
    return F.when(year.between(2000, 2030), year)


def fiscal_year_care(text: Column) -> Column:
    """March d, yyyy, else FYyyyy, else FYyy."""
    dated, full, short = (none_if_empty(F.regexp_extract(text, p, 1)).cast("int") for p in dims.BRIEF_YEARS)
    return F.coalesce(dated, full, 2000 + short)


def split_sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def field_of_label(label: Column, rules: list[tuple[str, bool, list[str]]]) -> Column:
    """The first rule that a lower-cased label meets: any of the words, or all of them."""
    chain, low = F, F.lower(label)
    for field, every, words in rules:
        hit = low.rlike("|".join(map(re.escape, words)).replace(r"\ ", " "))
        if every:
            hit = low.contains(words[0])
            for w in words[1:]:
                hit = hit & low.contains(w)
        chain = chain.when(hit, F.lit(field))
    return chain.otherwise(F.lit(None).cast("string"))


def map_label_care(label: Column) -> Column:
    return field_of_label(label, dims.BRIEF_RULES)


def map_label_page(label: Column, lender: bool = False) -> Column:
    return field_of_label(label, [(field, False, [word]) for word, field in (dims.LENDER_LABELS if lender else dims.PAGE_LABELS)])


def truthy(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0)) != 0


def confidence_generic(*fields: Column) -> Column:
    """Share of fields that are present, zero included."""
    return F.round(sum((c.isNotNull().cast("double") for c in fields), F.lit(0.0)) / len(fields), 2)


def confidence_care(*fields: Column) -> Column:
    """Share of fields that are present and not zero."""
    return F.round(sum((truthy(c).cast("double") for c in fields), F.lit(0.0)) / len(fields), 2)
