"""A stream of ratings gives what a batch gives, whatever the order of files, and through replays and restarts."""

import random

import pytest

from creditlake.operators import merge as M
from creditlake.streaming import first_wins as S

SCHEMA = "seq long, company_id long, agency string, source_id string, rating_symbol string"


@pytest.fixture
def land(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").json(f"{tmp_path}/in/{name}")

    return put


def test_reordered_and_replayed_files_with_a_restart_give_the_batch_result(spark, tmp_path, land):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 2, 3, None]), rng.choice(["A", "B", None]), rng.choice(["x", "y", "", None]), f"r{i}") for i in range(60)]
    parts = [rows[k::5] for k in range(5)]
    rng.shuffle(parts)

    def run():
        q = S.stream_first_wins(spark, f"{tmp_path}/in/*", SCHEMA, f"{tmp_path}/table", f"{tmp_path}/checkpoint", 1)
        q.awaitTermination()
        assert q.exception() is None

    for name, part in (("a", parts[4][::-1]), ("b", parts[1])):
        land(name, part)
    run()
    for name, part in (("c", parts[0]), ("d", parts[1]), ("e", parts[2] + parts[3] + parts[4])):
        land(name, part)
    run()
    got = S.read_first_wins(spark, SCHEMA, f"{tmp_path}/table")
    columns = ["company_id", "agency", "source_id", "rating_symbol"]
    all_rows = spark.createDataFrame(rows, SCHEMA)
    want = M.insert_ratings(all_rows.limit(0).drop("seq"), all_rows)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    for _ in range(2):
        spark.createDataFrame([(1, 1, "A", "x", "r", "sx"), (2, 1, "A", None, "q", "n2")], f"{SCHEMA}, first_wins_key string").write.mode("overwrite").parquet(f"{tmp_path}/t/batch=0")
    spark.createDataFrame([(0, 1, "A", "x", "first", "sx")], f"{SCHEMA}, first_wins_key string").write.parquet(f"{tmp_path}/t/batch=1")
    assert sorted(r.rating_symbol for r in S.read_first_wins(spark, SCHEMA, f"{tmp_path}/t").collect()) == ["first", "q"]


def test_a_batch_writes_only_what_it_improves_and_state_is_met_without_a_call_of_python_for_each_key(spark, tmp_path, land):
    run = lambda: S.stream_first_wins(spark, f"{tmp_path}/in/*", SCHEMA, f"{tmp_path}/table", f"{tmp_path}/checkpoint").awaitTermination()
    written = lambda n: sorted(r.rating_symbol for r in spark.read.schema(f"{SCHEMA}, {S.KEY} string").parquet(f"{tmp_path}/table/batch={n}").collect())
    rows = [(i + 10, i % 40, None if i % 3 else "A", "x" if i % 2 else None, f"r{i}") for i in range(200)]
    land("a", rows)
    run()
    land("b", rows)
    run()
    land("c", [(5, 1, None, "x", "earlier"), (900, 1, None, "x", "later"), (901, 77, "A", "x", "new")])
    run()
    assert len(written(0)) == 100 + 40 and written(1) == [] and written(2) == ["earlier", "new"]
    plan = S.first_wins(spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in/*"))._jdf.queryExecution().logical().toString()
    assert "Py" not in plan and "Pandas" not in plan
