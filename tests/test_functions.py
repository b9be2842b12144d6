"""Golden cases of ratings, names, numbers and years."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import functions as F

from creditlake.functions import names as T
from creditlake.functions import numbers as N
from creditlake.functions import ratings as R
from creditlake.functions import phrases as P

RATINGS = [
    ("[ICRA]AA+(Stable)", "AA+", 2, "Stable"), ("CRISIL AA+", "AA+", 2, ""), ("CARE AAA; Stable", "AAA", 1, "Stable"), ("IND A-/Stable", "A-", 7, "Stable"), ("CRISIL D", "D", 20, ""),
    ("CARE EDGE BBB-; Negative", "BBB-", 10, "Negative"), ("[ICRA]BB+ (Watch Negative)", "BB+", 11, "Watch Negative"), ("AA+", "AA+", 2, ""), ("BBB", "BBB", 9, ""),
    ("--, [ICRA]A4 ISSUER NOT COOPERATING", None, None, ""), (None, None, None, ""), ("", None, None, ""), ("CRISIL AA; watch with negative implications", "AA", 3, "Watch"),
    ("CARE CCC; unstable", None, None, "Stable"), ("Crisil A", "A", 6, ""),
]


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_ratings(spark):
    got = values(spark, [r[0] for r in RATINGS], R.normalize_rating)
    assert [(g.base, g.grade, g.outlook) for g in got] == [r[1:] for r in RATINGS]


def test_ratings_by_distinct_text(spark):
    df = spark.createDataFrame([(r[0],) for r in RATINGS] * 2, "t string")
    assert R.with_rating(df, "t").count() == 2 * len(RATINGS)


@pytest.mark.parametrize(
    "column, cases",
    [
        (T.normalize_name, {"  Acme Private Limited ": "acme pvt ltd", "Unlimited Foods Ltd": "unltd foods ltd", "A   B Limited": "a  b ltd"}),
        (T.normalize_name_ws, {"A \t B Limited": "a b ltd"}),
        (T.strip_suffix, {"  Acme Private Limited ": "acme", "Unlimited Foods Ltd": "unlimited foods", "A   B Limited": "a b", "X Co. Inc": "x"}),
        (T.is_state_owned, {"NTPC Ltd": True, "Sail": True, "Assail": False}),
        (T.sector_group, {"Power": "Infrastructure", "": "Corporate", "Unknown": "Corporate", "Banks": "Financial"}),
        (N.amount_pdf, {"1,234.5 Cr": 1234.5, "(123)": -123.0, "-5.2": -5.2, "1d": 1.0, "x": None}),
        (N.amount_bse, {"(123)": -123.0, "5 %": 5.0}),
        (N.amount_crisil, {"(123)": -123.0, "-5.2": 5.2, "--": None}),
        (N.amount_care, {"(123)": None, "12**": 12.0, "--": None}),
        (N.amount_plain, {"1,0": 10.0, "1_0": None, "": None}),
        (N.year_from_header, {"FY25": 2026, "FY2025": 2025, "2024-25": 2024, "Mar-25": None}),
        (N.year_header_crisil, {"Mar-25": 2025, "1999": None, "FY 2024": 2024}),
        (N.fiscal_year_care, {"March 31, 2024 (A)": 2024, "FY25": 2025}),
        (N.detect_unit, {"Rs. lakh": 0.01, "in million": 0.1, "(bn)": 100.0, "": 1.0}),
        (R.grade_label, {"2": "AA+", "25": "Grade 25"}),
        (T.quote, {"a b/c~*.pdf(1)": "a%20b/c~%2A.pdf%281%29"}),
    ],
)
def test_columns(spark, column, cases):
    assert dict(zip(cases, values(spark, list(cases), column), strict=True)) == cases


def test_year_columns(spark):
    df = spark.createDataFrame([(["x", "FY24", None, "2025"],)], "h array<string>")
    assert df.select(N.year_columns(F.col("h"))).first()[0] == [3, 1]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab .-", min_size=1, max_size=5), min_size=1, max_size=9, unique=True), st.lists(st.text("ab .-\n", max_size=14), min_size=1, max_size=12))
def test_phrases_in_one_pass_are_those_of_the_list(spark, phrases, texts):
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: (r.any, r.first) for r in df.select("t", P.holds_any(F.col("t"), phrases).alias("any"), P.first_held(F.col("t"), phrases).alias("first")).collect()}
    for t in texts:
        first = next((i for i, p in enumerate(phrases) if p in t), None)
        assert got[t] == (first is not None, first)
    assert got[None] == (None, None)
