"""Merges, the screen, matching and extraction on small tables."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from creditlake import schemas
from creditlake.operators import financials as X
from creditlake.operators import match as J
from creditlake.operators import merge as M
from creditlake.operators import reports
from creditlake.operators import screen as S
from creditlake.sources import readers

FIN = "company_id long, fiscal_year int, data_source string, extraction_confidence double, revenue_cr double, seq long"


def empty(spark, ddl):
    return spark.createDataFrame([], ddl)


def test_highest_confidence_wins_and_the_earlier_of_ties(spark):
    inc = spark.createDataFrame([(1, 2024, "a", 0.85, 1.0, 1), (1, 2024, "a", 0.9, 2.0, 2), (1, 2024, "a", 0.9, 3.0, 3), (1, None, "a", 0.1, 4.0, 4), (1, None, "a", 0.1, 5.0, 5)], FIN)
    got = M.merge_financials(empty(spark, "id long, " + FIN.rpartition(",")[0]), inc)
    assert sorted(r.revenue_cr for r in got.collect()) == [2.0, 4.0, 5.0]


def test_merge_is_idempotent_and_free_of_partitioning(spark):
    inc = spark.createDataFrame([(i % 5, 2020 + i % 3, "s", (i * 7 % 10) / 10, float(i), i) for i in range(60)], FIN)
    none = empty(spark, "id long, " + FIN.rpartition(",")[0])
    once = M.merge_financials(none, inc)
    again = M.merge_financials(once.drop("seq"), inc.repartition(7))
    key = lambda df: sorted((r.company_id, r.fiscal_year, r.revenue_cr) for r in df.collect())
    assert key(once) == key(again)


def test_ratings_are_added_once_per_source_id(spark):
    cols = "company_id long, agency string, source_id string, rating_symbol string"
    inc = spark.createDataFrame([(1, "X", "s", "A", 1), (1, "X", "s", "B", 2), (1, "X", None, "C", 3), (1, "X", "", "D", 4)], cols + ", seq long")
    got = M.insert_ratings(spark.createDataFrame([(2, "X", "s", "Z")], cols), inc)
    assert sorted(r.rating_symbol for r in got.collect()) == ["A", "C", "D", "Z"]


def test_companies_keep_the_first_spelling_and_the_last_value(spark):
    inc = spark.createDataFrame([("Acme Limited", None, 1), ("ACME LTD", "X", 2), ("acme ltd", None, 3)], "name string, isin string, seq long")
    (r,) = M.upsert_companies(empty(spark, schemas.COMPANIES), inc).collect()
    assert (r.name, r.isin, r.is_listed) == ("Acme Limited", "X", 0)


def test_stored_companies_of_one_name_count_as_one_with_the_values_of_the_least_id(spark):
    old = [(i, f"Acme {'LTD' if i % 2 else 'ltd'}", "acme ltd", None, None if i == 3 else f"I{i}", f"B{i}", None, i % 2) for i in range(3, 30)]
    for turn in (1, -1):
        for n in (1, 3):
            (r,) = M.upsert_companies(spark.createDataFrame(old[::turn], schemas.COMPANIES).repartition(n), spark.createDataFrame([("acme limited", "Z", 1)], "name string, cin string, seq long")).collect()
            assert (r.id, r.name, r.cin, r.isin, r.bse_code, r.is_listed) == (29, "Acme LTD", "Z", "I4", "B3", 1)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60))
def test_ids_are_dense_in_order(spark, keys):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(3)
    got = sorted((r.id, r.k) for r in M.assign_ids(df, ["k", "i"], 10).collect())
    assert [g[0] for g in got] == list(range(11, 11 + len(keys))) and [g[1] for g in got] == sorted(keys)


def test_ids_are_dense_in_order_over_rows_of_which_a_range_sort_draws_a_sample(spark):
    df = spark.range(60_000).select(F.xxhash64("id").alias("k"), "id", F.lit(None).alias("none"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = M.assign_ids(df, ["k"], 10, "n").select("k", "n", "none").collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert sorted(r.n for r in got) == list(range(11, 60_011))
    assert [r.k for r in sorted(got, key=lambda r: r.n)] == sorted(r.k for r in got)


def test_a_better_rating_elsewhere_hides_the_company(spark):
    c = spark.createDataFrame([(1, "N", "n", None, None, None, None, 0)], schemas.COMPANIES)
    r = spark.createDataFrame([(1, 1, "ICRA", "AA", 3), (2, 1, "CRISIL", "A", 6)], "id long, company_id long, agency string, rating_symbol string, rating_grade int")
    for col in ("outlook", "rating_date", "sector", "rationale_url"):
        r = r.withColumn(col, r.agency.substr(9, 1))
    f = empty(spark, schemas.FINANCIALS)
    assert S.screen(c, r, f, S.Filters(agencies=["CRISIL"])).count() == 0
    assert S.screen(c, r, f, S.Filters(agencies=["ICRA"])).count() == 1


def test_ties_of_the_best_rating_go_to_the_smallest_agency(spark):
    r = spark.createDataFrame([(1, 1, "CARE Edge", 3, "2024"), (2, 1, "CARE", 3, "2024"), (3, 2, "B9", 3, None), (4, 2, "B10", 3, None), (5, 3, "Z", None, "2024"), (6, 3, "Y", 20, "2020")], "id long, company_id long, agency string, rating_grade int, rating_date string")
    assert sorted((x.company_id, x.agency) for x in S.top_rating(r).collect()) == [(1, "CARE"), (2, "B10"), (3, "Y")]


def broadcasts(df):
    """Whether Spark broadcasts anything, with its own limits of size."""
    spark, name = df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(name)
    spark.conf.set(name, "10m")
    try:
        again = df.select("*")
        again.collect()
        return "Broadcast" in again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, held)


def test_prefixes_are_looked_up_without_a_broadcast(spark):
    p = spark.createDataFrame([("acme",), ("ac",), ("zz",), ("none such",), ("foods ltd",)], "prefix string")
    r = spark.createDataFrame([("the acme foods ltd", 3), ("acme", 5), ("buzz", 4)], "name_norm string, pos long")
    out = J.first_containing(p, r)
    assert sorted(map(tuple, out.collect())) == [("ac", 3), ("acme", 3), ("foods ltd", 3), ("zz", 4)]
    assert broadcasts(p.join(r, p["prefix"] == r["name_norm"])) and not broadcasts(out)


def test_an_index_is_matched_without_a_broadcast(spark):
    c = spark.createDataFrame([(1, "acme foods"), (2, "acme"), (3, "none such"), (4, "no file")], "company_id long, key string")
    x = spark.createDataFrame([(1, "the acme foods", "f1"), (2, "acme", "f2"), (3, "no file", "")], "pos long, key string, file string")
    out = J.match_index(c, x)
    assert sorted(map(tuple, out.collect())) == [(1, "f1"), (2, "f2")]
    assert not broadcasts(out)


@pytest.mark.parametrize("prefix", [20, 25])
def test_listed_companies_are_matched_without_a_broadcast(spark, prefix):
    long = "Acme Foods and Beverages of India"
    c = spark.createDataFrame([(1, "One", "I1"), (2, "Two Limited", None), (3, long[:prefix], None), (4, "None such", None)], "id long, name string, isin string")
    r = spark.createDataFrame([(1, "First", "I1", "a"), (2, "two ltd", None, "b"), (3, f"The {long}", None, "c")], "pos long, name string, isin string, code string")
    out = J.match_listed(c, r, prefix)
    assert sorted((x.company_id, x.rule, x.ref_code) for x in out.collect()) == [(1, "isin", "a"), (2, "name", "b"), (3, "prefix", "c")]
    assert not broadcasts(out)


def test_job_queues_are_ordered_and_limited(spark):
    c = spark.createDataFrame([(i, f"N{9 - i}", 0) for i in range(6)], "id long, name string, is_listed int")
    r = spark.createDataFrame([(i, "ICRA", f"s{i}", 1 + i % 3, f"u{i}", "Power") for i in range(6)] + [(i, "CRISIL", "x", 5, "u", "Infrastructure" if i % 2 else "Banks") for i in range(6)], "company_id long, agency string, source_id string, rating_grade int, rationale_url string, sector string")
    f = spark.createDataFrame([(0,)], "company_id long")
    assert [x.company_id for x in J.pdf_candidates(c, r, f, limit=3).collect()] == [3, 4, 1]
    assert [x.company_id for x in J.html_candidates(c, r, f, limit=3).collect()] == [4, 2, 5]
    assert [x.company_id for x in J.unrated_candidates(c, r, f, "CARE Edge", limit=2).collect()] == [1, 2]
    assert [x.company_id for x in J.rated_without_financials(c, r, f, "ICRA").collect()] == [1, 2, 3, 4, 5]
    ids = spark.createDataFrame([(x,) for x in ("10", "9", "x", "2")], "id string")
    assert [x.id for x in J.missing_companies(ids, r.where("false"), 3).collect()] == ["x", "2", "9"]


def test_user_sort_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, "c", 2.0)], "company_id long, `Company Name` string, x double")
    assert [r.company_id for r in S.user_sort(df, "x", True).collect()] == [2, 3, 1]
    assert [r.company_id for r in S.user_sort(df, "x", False, 2).collect()] == [3, 2]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", max_size=8), min_size=1, max_size=12), st.lists(st.text("abc", max_size=6), min_size=1, max_size=8))
def test_substring_join_equals_brute_force(spark, names, prefixes):
    ref = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "pos long, name_norm string")
    got = {r.prefix: r.pos for r in J.first_containing(spark.createDataFrame([(p,) for p in prefixes], "prefix string"), ref).collect()}
    want = {p: next((i for i, n in enumerate(names) if p in n), None) for p in prefixes}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_containment_by_the_rarest_gram_at_all_lengths(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
    names = [" ".join([*(word() for _ in range(rng.randint(0, 4))), "private limited"]) for _ in range(60)] + ["", "ab"]
    whole = rng.choices(names, k=80)
    prefixes = {n[(a := rng.randrange(len(n) + 1)) : a + rng.randint(0, 30)] for n in whole} | {"private limited", "no such name at all", "zz", "a" * 17}
    ref = spark.createDataFrame(list(enumerate(names)), "pos long, name_norm string")
    got = {r.prefix: r.pos for r in J.first_containing(spark.createDataFrame([(p,) for p in prefixes], "prefix string"), ref).collect()}
    assert got == {p: i for p in prefixes if (i := next((i for i, n in enumerate(names) if p in n), None)) is not None}
    assert J.first_containing(ref.select(F.col("name_norm").alias("prefix")).limit(0), ref).count() == 0


def test_rows_of_the_inverted_list_grow_with_the_length_of_names_alone(spark):
    made = [spark.range(1).select(F.size(J.grams(F.repeat(F.lit("abcdefghijk"), n), F.lit(q)))).first()[0] for n in (10, 20) for q in J.GRAMS]
    assert all(m <= 11 for m in made)  # distinct ones only
    name = F.sha2(F.lit("x"), 512)
    assert [spark.range(1).select(F.size(J.grams(name, F.lit(q)))).first()[0] <= 128 - q + 1 for q in J.GRAMS] == [True] * 3


def test_limits_of_reads_and_matches(spark, tmp_path):
    c = spark.createDataFrame([(i, f"Acme {i} Ltd", None) for i in (4, 2, 9)], "id long, name string, isin string")
    r = spark.createDataFrame([(i, f"acme {i} ltd", None, str(i)) for i in (2, 4, 9)], "pos long, name string, isin string, code string")
    assert sorted(x.company_id for x in J.match_listed(c, r, 20, limit=2).collect()) == [2, 4]
    (tmp_path / "s.json").write_text('[{"value": "a"}, {"value": ""}, {"value": "b"}, {"value": "c"}]')
    assert [x.value for x in readers.read_suggest(spark, str(tmp_path / "s.json"), limit=2).collect()] == ["a", "b"]


def test_match_prefers_isin_then_name_then_prefix(spark):
    c = spark.createDataFrame([(1, "Alpha Ltd", "I1"), (2, "Beta Limited", None), (3, "Gamma", None), (4, "Nothing like it", None)], "id long, name string, isin string")
    r = spark.createDataFrame([(0, "Zeta", "I1", "z"), (1, "beta ltd", None, "b"), (2, "beta ltd", None, "b2"), (3, "old gamma works", None, "g"), (4, "gamma", "I9", "g2")], "pos long, name string, isin string, code string")
    got = {x.company_id: (x.rule, x.ref_code) for x in J.match_listed(c, r.where("pos <> 4"), 20).collect()}
    assert got == {1: ("isin", "z"), 2: ("name", "b2"), 3: ("prefix", "g")}


def test_text_table(spark):
    block = "\n".join(["Key financial indicators (audited)", "Company Name FY2024 FY2025", "Operating income 4269.1 4329.8", "PAT 446.4 341.6", "OPBDIT/OI 13.9% 10.4%", "Total debt/OPBDIT (times) 0.0 0.2", "Interest coverage (times) 103.7 26.2", "Note: x", "PAT 1 2"])
    (r,) = X.extract_text_table(spark.createDataFrame([(1, block)], "doc_id long, text string")).collect()
    assert (r.fiscal_year, r.revenue_cr, r.pat_cr, r.ebitda_margin_pct, r.interest_coverage, r.ebitda_cr, r.total_debt_cr, r.net_debt_cr) == (2025, 4329.8, 341.6, 10.4, 26.2, 450.3, 90.06, None)


def test_cleanup_is_idempotent(spark, sf):
    from creditlake.plans import adapters as A

    t = dict(companies=A.companies(spark, sf), ratings=A.ratings(spark, sf), financials=A.financials(spark, sf), notes=A.notes(spark, sf))
    once, _ = reports.cleanup(*t.values(), [7])
    report = reports.cleanup(*once.values(), [7])[1].collect()
    assert all(r.rows_before == r.rows_after for r in report)


def test_readers_of_files(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return f"file://{tmp_path / name}"

    assert [r.value for r in readers.read_suggest(spark, put("s.json", '[{"value": "A:b"}, {"value": ""}]')).collect()] == ["A:b"]
    assert readers.read_listing_docs(spark, put("d.json", '{"docs": [{"companyName": "A", "ratingFileName": "f"}, {"companyName": "B"}]}')).count() == 1
    (i,) = readers.read_issuers(spark, put("i.json", '[{"issuer_id": 3, "name": "N", "ratingsList": [{"rating": "IND A / Stable"}]}]')).collect()
    assert (i.issuer_id, i.name, i.ratingsList[0].rating) == (3, "N", "IND A / Stable")
    assert readers.read_press_releases(spark, put("p.json", '{"data": [{"CompanyName": "A", "FileURL": "u"}]}')).first().file_url == "u"
    assert readers.read_scrips(spark, put("c.json", '{"Table": [{"SCRIP_CD": "1", "SCRIP_NAME": " N "}]}')).first().name == "N"
    assert readers.read_results(spark, put("r.json", '[{"PBT": "1"}]')).first().rec == {"PBT": "1"}
    none = empty(spark, schemas.NOTES)
    assert [tuple(r) for r in readers.import_notes(spark, put("n.json", '{"5": " x ", "6": " "}'), none).collect()] == [(5, "x")]


def test_broken_embedded_json_gives_no_rows(spark):
    df = spark.createDataFrame([(1, "var RatingDetails = {oops};\n"), (2, None), (3, "")], "id long, html string")
    assert readers.read_embedded_detail(df).count() == 0 and readers.read_embedded_array(df).count() == 0
