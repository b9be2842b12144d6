"""Helpers that the operators share."""

import os

from creditlake.llm import common


def test_parts_grow_with_the_bytes_that_are_read(spark, sf, monkeypatch, tmp_path):
    docs = common.read(spark, sf, "documents")
    size = os.path.getsize(f"{sf}/documents.parquet")
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.input_bytes(docs) == size and common.partitions(docs) == setting
    twice = common.only(docs, text=common.text_of(docs)).unionByName(common.only(docs, text=docs["text"]))
    joined = docs.alias("a").join(docs.alias("b"), "doc_id")
    monkeypatch.setattr(common, "PART_BYTES", size // (10 * setting))
    assert 10 * setting <= common.partitions(docs) <= 11 * setting
    assert common.partitions(joined) == common.partitions(twice) >= 20 * setting  # tables that are read count, not what a join might give
    monkeypatch.setattr(common, "MOST_PARTS", 7)
    assert common.partitions(docs) == max(7, setting)


def test_parts_of_rows_that_spark_was_handed(spark):
    setting = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.partitions(spark.createDataFrame([(1, "a")], "doc_id long, text string")) == setting
    assert common.partitions(spark.createDataFrame([], "doc_id long, text string")) == setting
    assert common.partitions(spark.range(10).rdd.map(lambda r: (r[0],)).toDF(["id"])) == setting
