"""High-water marks, fixed-order runs, streams and writers."""

import pytest
from pyspark.sql import functions as F

from creditlake.sources import writers as W
from creditlake.streaming import ingest as R


def test_steps_run_in_order_and_can_be_chosen():
    done = []
    steps = [(n, lambda n=n: done.append(n) or n) for n in ("a", "b", "c")]
    assert R.run_pipeline(steps) == {"a": "a", "b": "b", "c": "c"} and done == ["a", "b", "c"]
    assert R.run_pipeline(steps, {"c", "a"}) == {"a": "a", "c": "c"}


def test_checkpoints_compare_as_numbers(spark):
    df = spark.createDataFrame([("9",), ("10",), ("x",), (None,), ("100",)], "id string")
    assert [r.id for r in R.after_checkpoint(df, "id", 9).collect()] == ["10", "100"]
    assert [r.id for r in R.after_checkpoint(df, "id", 5, 10).collect()] == ["9", "10"]
    assert [r.id for r in R.after_checkpoint(df, "id", 8, None, 2).collect()] == ["9", "10"] and [r.id for r in R.after_checkpoint(df, "id", 8, 9, 2).collect()] == ["9"]
    assert R.next_checkpoint(df, "id", 7) == 100 and R.next_checkpoint(df.limit(0), "id", 7) == 7


def test_date_chunks(spark):
    df = spark.sql("select date'2024-01-15' a, date'2024-03-10' b")
    months = df.select(F.explode(R.date_chunks(F.col("a"), F.col("b"), True)).alias("x")).select("x.*").collect()
    assert [tuple(m) for m in months] == [("01/01/2024", "01/31/2024"), ("02/01/2024", "02/29/2024"), ("03/01/2024", "03/10/2024")]
    days = df.select(F.size(R.date_chunks(F.col("a"), F.col("b"), False)).alias("n")).first().n
    assert days == 56


def test_index_keeps_what_it_has(spark):
    docs = spark.createDataFrame([("2024-01-02", 2, "Acme Ltd", "f2"), ("2024-01-02", 1, "ACME Limited", "f1"), ("2023-01-01", 1, "Old Co", "f0"), ("2024-02-01", 1, "Known Inc", "f9")], "d string, pos int, name string, file string").withColumn("chunk_date", F.to_date("d"))
    have = spark.createDataFrame([("known", "Known Inc", "f3")], "key string, name string, file string")
    got = {r.key: r.file for r in R.build_name_index(docs, have, "2023-06-01").collect()}
    assert got == {"known": "f3", "acme": "f1"}


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    seen = []
    merge = lambda batch, n: seen.extend(r.v for r in batch.collect())
    for v in (1, 2):
        spark.createDataFrame([(v,)], "v long").write.mode("append").json(f"{tmp_path}/in")
        R.stream_ingest(spark, f"{tmp_path}/in", "v long", merge, f"{tmp_path}/ck").awaitTermination()
    assert seen == [1, 2]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "X", "a"), (2, None, "b")], "company_id long, agency string, t string")
    assert spark.read.parquet(W.write_table(df, str(tmp_path), "ratings")).count() == 2
    assert spark.read.csv(W.export_screen(df, f"{tmp_path}/csv"), header=True).columns == ["agency", "t"]
    W.write_backup(df, f"{tmp_path}/backup")
    with pytest.raises(Exception, match="already exists"):
        W.write_backup(df, f"{tmp_path}/backup")
