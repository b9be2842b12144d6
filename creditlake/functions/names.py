"""Company names: keys by which companies are matched, and words found in names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from creditlake import dims
from creditlake.functions.phrases import first_held, holds_any


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once, however often fn uses it; keeps generated code small."""
    return F.get(F.transform(F.array(value), fn), 0)


def normalize_name(name: Column) -> Column:
    """Key form: lower case, stripped, short company forms, pairs of blanks made one in a single pass."""
    c = strip(F.lower(name))
    for long, short in (("limited", "ltd"), ("private", "pvt"), ("  ", " ")):
        c = F.replace(c, F.lit(long), F.lit(short))
    return c


def normalize_name_ws(name: Column) -> Column:
    """Key form with every run of white space made one blank."""
    c = strip(F.lower(name))
    for long, short in (("limited", "ltd"), ("private", "pvt")):
        c = F.replace(c, F.lit(long), F.lit(short))
    return F.regexp_replace(c, r"\s+", " ")


def strip_suffix(name: Column) -> Column:
    """Index form: without company forms as whole words."""
    c = F.regexp_replace(name, r"(?i)\b(limited|ltd|private|pvt|llp|llc|co\.?|corp\.?|inc\.?|plc)\b\.?", "")
    return strip(F.regexp_replace(F.lower(c), r"\s+", " "))


def strip_suffix_short(name: Column) -> Column:
    """Lookup form: without the five commonest company forms."""
    c = F.regexp_replace(F.lower(name), r"\b(limited|ltd|private|pvt|llp)\b", "")
    return strip(F.regexp_replace(c, r"\s+", " "))


def is_state_owned(name: Column) -> Column:
    """Whether the name holds one of the fragments, which may reach over its ends by a blank."""
    return holds_any(F.concat(F.lit(" "), F.lower(name), F.lit(" ")), dims.STATE_OWNED)


def first_word_in(text: Column, table: list[tuple[str, str]]) -> Column:
    """Label of the first entry, in table order, whose word occurs in the lower-cased text; '' if none does."""
    labels = F.array(*(F.lit(v) for _, v in table))
    return F.coalesce(F.get(labels, first_held(F.lower(text), [w for w, _ in table])), F.lit(""))


def keyword_sector(name: Column, text: Column) -> Column:
    return first_word_in(F.concat(name, F.lit(" "), text), dims.SECTOR_WORDS)


def sector_from_criteria(criteria: Column) -> Column:
    return first_word_in(F.coalesce(criteria, F.lit("")), dims.CRITERIA_SECTORS)


def sector_group(sector: Column) -> Column:
    """Group of a sector by exact match, otherwise Corporate."""
    pairs = [x for group, members in dims.SECTOR_GROUPS.items() for m in members for x in (F.lit(m), F.lit(group))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(sector, F.lit("?"))), F.lit("Corporate"))


def search_terms(name: Column) -> Column:
    """The name, and its first word longer than three characters if there is one."""
    word = F.try_element_at(F.filter(F.split(strip(name), r"\s+"), lambda w: F.length(w) > 3), F.lit(1))
    return F.array_compact(F.array(name, word))


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def quote(c: Column) -> Column:
    """Percent-encoding that keeps / and ~ and writes a blank as %20."""
    out = F.url_encode(c)
    for was, now in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(was), F.lit(now))
    return out


def rationale_url(agency: Column, key: Column, name: Column, file: Column) -> Column:
    """Link to the agency's rationale; null without what the link needs, a general page for a CRISIL rating without a file."""
    u = dims.RATIONALE_URLS
    icra = F.when(none_if_empty(key).isNotNull(), F.concat(F.lit(u["ICRA"].split("{id}")[0]), key, F.lit("&CompanyName="), quote(name)))
    crisil = F.when(none_if_empty(file).isNotNull(), F.concat(F.lit(u["CRISIL"].split("{")[0]), quote(file))).otherwise(F.lit(u["CRISIL generic"]))
    india = F.concat(F.lit(u["India Ratings"].split("{")[0]), key)
    care = F.concat(F.lit(u["CARE Edge"].split("{")[0]), file)
    return F.when(agency == "ICRA", icra).when(agency == "CRISIL", crisil).when(agency == "India Ratings", india).when(agency == "CARE Edge", care)
