"""Stored tables: merges touch only the parts of their rows and give what merges of whole tables give."""

import random
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from creditlake import schemas
from creditlake.operators import increment as I
from creditlake.operators import merge as M
from creditlake.operators import screen as S


def files(table):
    """Data files by part."""
    out = {}
    for p in Path(table.path.removeprefix("file://")).glob("part=*/*.parquet"):
        out.setdefault(int(p.parent.name.removeprefix("part=")), set()).add(p.name)
    return out


def changed_parts(before, after):
    return {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}


def frame(spark, rows, schema, columns):
    return spark.createDataFrame(rows, schema).select(*columns)


@pytest.fixture
def path(tmp_path):
    return lambda: f"file://{tmp_path}/{uuid.uuid4().hex}"


RATED = "seq long, company_id long, agency string, source_id string, rating_symbol string, rating_grade int, rating_date string"
FIGURES = "seq long, company_id long, fiscal_year int, data_source string, extraction_confidence double, revenue_cr double"


def rated(rng, n, start=0):
    return [(start + i, rng.randrange(12), rng.choice(["ICRA", "CARE"]), rng.choice(["a", "b", "", None]), rng.choice("ABC"), rng.randrange(1, 20), f"2024-01-{rng.randrange(10, 28)}") for i in range(n)]


def figures(rng, n, start=0):
    return [(start + i, rng.randrange(12), rng.choice([2023, 2024, 0, None]), rng.choice(["x", "y", "", None]), rng.choice([None, 0.5, 0.9]), float(rng.randrange(100))) for i in range(n)]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_ratings_are_added_and_nothing_is_rewritten(spark, path):
    rng = random.Random(1)
    old = spark.createDataFrame(rated(rng, 40), RATED).withColumnRenamed("seq", "id")
    one, two = (spark.createDataFrame(rated(rng, 60, s), RATED) for s in (100, 200))
    old = M.new_ratings(old.limit(0).drop("id"), old.withColumnRenamed("id", "seq"))
    table = I.stored_ratings(path(), 4, 2).create(old)
    before = files(table)
    for load in (one, two):
        I.insert_into(table, load)
    after = files(table)
    assert all(names <= after[p] for p, names in before.items())
    full = M.insert_ratings(M.insert_ratings(old, one), two)
    columns = ("company_id", "agency", "source_id", "rating_symbol", "rating_date")
    assert rows(table.read(spark), *columns) == rows(full, *columns)


def test_figures_of_one_changed_key_rewrite_one_part(spark, path):
    rng = random.Random(2)
    old = spark.createDataFrame(figures(rng, 80), FIGURES).withColumnRenamed("seq", "id")
    keys = ["company_id", "fiscal_year", "data_source"]
    old = M.merge_financials(old.limit(0), old.withColumnRenamed("id", "seq"))
    table = I.stored_financials(path(), 8, 4).create(old)
    key = old.where("fiscal_year > 0 and data_source > ''").first()
    better = spark.createDataFrame([(1, key.company_id, key.fiscal_year, key.data_source, 1.0, -7.0)], FIGURES)
    before = files(table)
    I.merge_into(table, better)
    assert len(changed_parts(before, files(table))) == 1
    got = table.read(spark).where((F.col("company_id") == key.company_id) & (F.col("fiscal_year") == key.fiscal_year) & (F.col("data_source") == key.data_source)).collect()
    assert [r.revenue_cr for r in got] == [-7.0]
    before = files(table)
    I.merge_into(table, spark.createDataFrame([(2, 3, None, "x", 1.0, 5.0), (3, 3, 2024, "", 1.0, 6.0)], FIGURES))
    after = files(table)
    assert changed_parts(before, after) and all(names <= after[p] for p, names in before.items())  # rows without a key are added only
    load = spark.createDataFrame(figures(rng, 90, 300), FIGURES)
    full = M.merge_financials(table.read(spark), load)
    columns = (*keys, "extraction_confidence", "revenue_cr")
    want = rows(full, *columns)
    I.merge_into(table, load)
    assert rows(table.read(spark), *columns) == want


def test_companies_keep_ids_and_new_ones_are_numbered_by_arrival(spark, path):
    table = I.stored_companies(path(), 4)
    old = spark.createDataFrame([(5, "Acme Ltd", "acme ltd", 1), (9, "Beta Ltd", "beta ltd", 0)], "id long, name string, name_normalized string, is_listed int")
    table.create(old)
    load = spark.createDataFrame([(3, "Zeta", "Z"), (1, "ACME Limited", "I"), (2, "Nu", None), (4, "zeta ", "Y")], "seq long, name string, isin string")
    changed = I.upsert_into(table, load)
    got = {r.name: (r.id, r.isin, r.is_listed) for r in table.read(spark).collect()}
    assert got == {"Acme Ltd": (5, "I", 1), "Beta Ltd": (9, None, 0), "Nu": (10, None, 0), "Zeta": (11, "Y", 0)}
    assert sorted(r.company_id for r in changed.collect()) == [5, 10, 11]
    assert table.read(spark).columns == [c.split()[0] for c in schemas.COMPANIES.split(", ")]


def test_kept_screen_equals_a_full_one_after_inserts_better_merges_and_deletes(spark, path):
    rng = random.Random(3)
    c = spark.createDataFrame([(i, f"Co {i}", 0) for i in range(12)], "id long, name string, is_listed int").withColumns({"bse_code": F.lit(None).cast("string"), "isin": F.lit(None).cast("string")})
    first = spark.createDataFrame(rated(rng, 12), RATED), spark.createDataFrame(figures(rng, 12), FIGURES)
    ratings, financials = (make(path(), 4, 2).create(df.withColumn("id", F.col("seq"))) for make, df in ((I.stored_ratings, first[0]), (I.stored_financials, first[1])))
    full = lambda: rows(S.screen(c, ratings.read(spark), financials.read(spark), None, order=False), *S.SCREEN_COLUMNS)
    kept = I.stored_screen(path(), 16).create(S.screen(c, ratings.read(spark), financials.read(spark), None, order=False))
    one = spark.createDataFrame([(90, 4, "ICRA", "new", "A", 1, "2025-01-01")], RATED).withColumn("id", F.col("seq"))
    before = files(kept)
    assert I.refresh_screen(kept, c, ratings, financials, I.insert_into(ratings, one)) <= 2
    assert len(changed_parts(before, files(kept))) == 1 and rows(kept.read(spark), *S.SCREEN_COLUMNS) == full()
    load = spark.createDataFrame(rated(rng, 9, 100), RATED).withColumn("id", F.col("seq")), spark.createDataFrame([(200, 4, 2031, "x", 1.0, 3.0), *figures(rng, 9, 201)], FIGURES).withColumn("id", F.col("seq"))
    changed = I.insert_into(ratings, load[0]).unionByName(I.merge_into(financials, load[1]))
    I.refresh_screen(kept, c, ratings, financials, changed)
    assert rows(kept.read(spark), *S.SCREEN_COLUMNS) == full()
    gone = spark.createDataFrame([(4,), (5,), (77,)], "company_id long")
    I.delete_from(ratings, gone)
    I.refresh_screen(kept, c, ratings, financials, gone)
    assert rows(kept.read(spark), *S.SCREEN_COLUMNS) == full() and kept.read(spark).where("company_id in (4, 5)").count() == 0
    everyone = c.select(F.col("id").alias("company_id"))
    I.delete_from(ratings, everyone)
    I.refresh_screen(kept, c, ratings, financials, everyone)
    assert files(kept) == {} or kept.read(spark).count() == 0


def test_only_wanted_parts_are_read(spark, path):
    table = I.stored_financials(path(), 8, 2).create(spark.createDataFrame(figures(random.Random(5), 50), FIGURES))
    plan = table.read(spark, [1, 3])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1][:60]
