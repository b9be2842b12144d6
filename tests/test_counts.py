"""Distinct counts from kept bitmaps equal those over all rows."""

import random

from pyspark.sql import functions as F

from creditlake.operators import counts as N
from creditlake.operators import reports


def test_counts_after_several_loads_equal_those_over_all_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, 0, -5, 1, 2, 32768, 32769, 40000, 10**12, rng.randrange(70000)]), rng.choice(["a", "b", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, company_id long, data_source string").withColumn("scraped_at", F.col("id").cast("string"))
    for n in (0, 1, 2, 1):
        part = df.where(F.col("id") % 3 == n)
        N.keep_load(str(tmp_path), n, part, part, part)
    want = reports.financials_by_source(df).collect()
    assert sorted(map(str, N.kept_by_source(spark, str(tmp_path)).collect())) == sorted(map(str, want))
    full, kept = reports.summary_stats(df, df, df).first(), N.kept_summary(spark, str(tmp_path)).first()
    assert full.asDict() == kept.asDict()


def test_empty_loads_count_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id long, company_id long, data_source string, scraped_at string")
    N.keep_load(str(tmp_path), 0, df, df, df)
    assert N.kept_summary(spark, str(tmp_path)).first().asDict() == {"companies": 0, "rated": 0, "ratings": 0, "with_financials": 0, "last_scraped": None}
    assert N.kept_by_source(spark, str(tmp_path)).count() == 0
