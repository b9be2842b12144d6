"""Candidates for enrichment, and matching of companies across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditlake.functions.names import none_if_empty, normalize_name, normalize_name_ws


def _without(df: DataFrame, table: DataFrame) -> DataFrame:
    return df.join(table.select("company_id"), "company_id", "left_anti")


def _queue(df: DataFrame, order: list[str], limit: int | None) -> DataFrame:
    """A job's rows in order, all or the first so many."""
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def pdf_candidates(companies: DataFrame, ratings: DataFrame, financials: DataFrame, min_grade: int = 5, limit: int | None = None) -> DataFrame:
    """Unlisted companies with an ICRA rating of at most this grade and a source_id, and no financials."""
    r = ratings.where((F.col("agency") == "ICRA") & (F.col("rating_grade") <= min_grade) & none_if_empty(F.col("source_id")).isNotNull()).select("company_id", "source_id", "rating_grade")
    c = companies.where(F.coalesce("is_listed", F.lit(0)) == 0).select(F.col("id").alias("company_id"), "name")
    return _queue(_without(c.join(r, "company_id"), financials).distinct(), ["rating_grade", "name", "source_id"], limit)


def html_candidates(companies: DataFrame, ratings: DataFrame, financials: DataFrame, limit: int | None = None) -> DataFrame:
    """CRISIL-rated companies without financials: others first, then infrastructure, then the financial sector."""
    turn = F.when(F.col("sector") == "Financial Sector", 3).when(F.col("sector") == "Infrastructure", 2).otherwise(1)
    r = ratings.where(F.col("agency") == "CRISIL").select("company_id", "rating_grade", turn.alias("turn"))
    c = companies.select(F.col("id").alias("company_id"), "name")
    return _queue(_without(c.join(r, "company_id"), financials).distinct(), ["turn", "rating_grade", "name"], limit)


def unrated_candidates(companies: DataFrame, ratings: DataFrame, financials: DataFrame, agency: str, limit: int | None = None) -> DataFrame:
    """Companies with neither a rating by the agency nor financials."""
    c = companies.select(F.col("id").alias("company_id"), "name")
    return _queue(_without(_without(c, ratings.where(F.col("agency") == agency)), financials), ["company_id"], limit)


def rated_without_financials(companies: DataFrame, ratings: DataFrame, financials: DataFrame, agency: str, limit: int | None = None) -> DataFrame:
    """Rated companies with a link and without financials, one row for each link."""
    r = ratings.where((F.col("agency") == agency) & none_if_empty(F.col("rationale_url")).isNotNull()).select("company_id", "rationale_url")
    return _queue(_without(companies.select(F.col("id").alias("company_id"), "name").join(r, "company_id"), financials).distinct(), ["company_id", "rationale_url"], limit)


def missing_companies(universe: DataFrame, ratings: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids of a universe that no stored link names, in numeric order."""
    known = ratings.select(F.regexp_extract("rationale_url", r"CompanyId=(\d+)", 1).alias("id")).where("id <> ''").distinct()
    return _queue(universe.join(known, "id", "left_anti"), [F.col("id").try_cast("long")], limit)


def new_names(search: DataFrame, companies: DataFrame) -> DataFrame:
    """Distinct names whose key no company has."""
    s = search.select("name").distinct().withColumn("name_normalized", normalize_name(F.col("name")))
    return s.join(companies.select("name_normalized"), "name_normalized", "left_anti")


def last_wins(df: DataFrame, key: str, values: list[str], pos: str = "pos") -> DataFrame:
    """One row for each key: values of its last occurrence, place of its first."""
    return df.where(none_if_empty(F.col(key)).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*values), pos).alias("_v"), F.min(pos).alias(pos)).select(key, "_v.*", pos)


def _met(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the tables, neither of which is broadcast.

    Left to itself Spark takes the compressed bytes of files for the size of what is made from them, and collects on the driver what is
    ten times as large there.
    """
    return left.join(right.hint("merge"), on, how)


#: Lengths of q-grams. A prefix is looked up by those of the longest that fits into it, as longer ones are rarer.
GRAMS = (4, 8, 16)


def grams(name: Column, q: Column) -> Column:
    """Distinct substrings of length q of a name, one for each place at most."""
    made = F.transform(F.sequence(F.lit(1), F.length(name) - q + 1), lambda i: F.substring(name, i, q))
    return F.when(F.length(name) >= q, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def _gram_length(prefix: Column) -> Column:
    out = F.lit(GRAMS[0])
    for q in GRAMS[1:]:
        out = F.when(F.length(prefix) >= q, q).otherwise(out)
    return out


def first_containing(prefixes: DataFrame, reference: DataFrame) -> DataFrame:
    """prefix → place of the first reference name that contains it, by an inverted list of q-grams.

    A reference name gives one row for each place and length of GRAMS, whatever the lengths of prefixes are; grams are counted
    before they are exchanged. A prefix meets the names that hold its rarest gram and no others, and each of those is verified; a
    prefix with a gram that no name has is in none. Prefixes shorter than any gram are few, but each is a substring of
    most names, so their substrings are folded to the first place before they meet.
    """
    short = GRAMS[0]
    p = prefixes.select("prefix").distinct()
    needs = p.where(F.length("prefix") >= short).withColumn("q", _gram_length(F.col("prefix"))).withColumn("gram", F.explode(grams(F.col("prefix"), F.col("q"))))
    lists = reference.select("name_norm", "pos", F.explode(F.concat(*(grams(F.col("name_norm"), F.lit(q)) for q in GRAMS))).alias("gram"))
    sizes = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    found = _met(needs, sizes, "gram", "left").groupBy("prefix").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    long = _met(lists, found.where("n > 0"), "gram").where(F.contains("name_norm", "prefix")).groupBy("prefix").agg(F.min("pos").alias("pos"))
    tiny = F.expr(f"flatten(transform(sequence(0, {short - 1}), k -> if(k = 0, array(''), if(length(name_norm) < k, array(), transform(sequence(1, length(name_norm) - k + 1), i -> substring(name_norm, i, k))))))")
    few = reference.select("pos", F.explode(F.array_distinct(tiny)).alias("part")).groupBy("part").agg(F.min("pos").alias("pos"))
    return long.unionByName(_met(p.where(F.length("prefix") < short), few, F.col("prefix") == F.col("part")).select("prefix", "pos"))


def match_listed(companies: DataFrame, reference: DataFrame, prefix: int, limit: int | None = None) -> DataFrame:
    """company_id, rule, ref_name, ref_isin, ref_code: by ISIN, else by name, else by the first reference that contains the name's start.

    reference: pos, name, isin, code. Of reference rows with the same key the last gives the values, the first the place. limit: a
    trial run over so many companies, the least ids.
    """
    if limit is not None:
        companies = _queue(companies, ["id"], limit)
    r = reference.select("pos", "name", "isin", "code", normalize_name_ws(F.col("name")).alias("name_norm"))
    c = companies.select(F.col("id").alias("company_id"), none_if_empty(F.col("isin")).alias("isin"), normalize_name_ws(F.col("name")).alias("name_norm"))
    by_isin = last_wins(r, "isin", ["name", "code"])
    by_name = last_wins(r, "name_norm", ["name", "isin", "code"])
    out = _met(c, by_isin.select("isin", F.struct("name", "isin", "code").alias("i")), "isin", "left")
    out = _met(out, by_name.select("name_norm", F.struct("name", "isin", "code").alias("n")), "name_norm", "left")
    rest = out.where("i is null and n is null").select(F.substring("name_norm", 1, prefix).alias("prefix")).distinct()
    held = _met(first_containing(rest, by_name), by_name.select("pos", F.struct("name", "isin", "code").alias("p")), "pos").select("prefix", "p")
    out = _met(out.withColumn("prefix", F.substring("name_norm", 1, prefix)), held, "prefix", "left")
    rule = F.when(F.col("i").isNotNull(), "isin").when(F.col("n").isNotNull(), "name").when(F.col("p").isNotNull(), "prefix")
    hit = F.coalesce("i", "n", "p")
    return out.select("company_id", rule.alias("rule"), hit["name"].alias("ref_name"), hit["isin"].alias("ref_isin"), hit["code"].alias("ref_code")).where("rule is not null")


def match_index(companies: DataFrame, index: DataFrame, prefix: int = 30) -> DataFrame:
    """company_id, file: by index key, else by the first key that contains the start; an entry without a file is no match.

    companies: company_id, key; index: pos, key, file.
    """
    names = index.select("pos", F.col("key").alias("name_norm"), "file")
    exact = _met(companies, names.select(F.col("name_norm").alias("key"), F.col("file").alias("exact"), F.lit(True).alias("hit")), "key", "left")
    rest = exact.where("hit is null").select(F.substring("key", 1, prefix).alias("prefix"))
    held = _met(first_containing(rest, names), names.select("pos", F.col("file").alias("held")), "pos").select("prefix", "held")
    out = _met(exact.withColumn("prefix", F.substring("key", 1, prefix)), held, "prefix", "left")
    return out.select("company_id", F.when(F.col("hit"), F.col("exact")).otherwise(F.col("held")).alias("file")).where(none_if_empty(F.col("file")).isNotNull())


def match_search(results: DataFrame, companies: DataFrame) -> DataFrame:
    """company_id, result: of each company's search results the first equal to its name, or where one starts the other, 10 long at least.

    results: company_id, pos, name.
    """
    own = companies.select(F.col("id").alias("company_id"), normalize_name_ws(F.col("name")).alias("own"))
    met = results.withColumn("got", normalize_name_ws(F.col("name"))).join(own, "company_id")
    near = (F.least(F.length("own"), F.length("got")) >= 10) & (F.col("own").startswith(F.col("got")) | F.col("got").startswith(F.col("own")))
    return met.where((F.col("own") == F.col("got")) | near).groupBy("company_id").agg(F.min_by("name", "pos").alias("result"))


def index_file_lookup(companies: DataFrame, index: DataFrame) -> DataFrame:
    """companies with the file of their lookup key, or null."""
    return companies.join(index.select("key", "file"), "key", "left")


def latest_press_release(releases: DataFrame) -> DataFrame:
    """Of each company the newest by date as text, missing as ''; ties keep the first."""
    w = Window.partitionBy("company_id").orderBy(F.coalesce("published", F.lit("")).desc(), "pos")
    return releases.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
