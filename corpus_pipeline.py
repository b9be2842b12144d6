"""The corpus pipeline: toxicity, line dedup, near duplicates, repeated passages, packing.

Each stage works on all documents that its predecessor kept, and its decisions take effect: toxic documents go, repeated lines and
passages are cut out of texts, one document of each group of near duplicates stays, and what is left is packed into sequences.
Stages keep null texts and repeated rows as their operators define, and pass all other columns on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm import op03_lines, op04_suffixes, op05_toxicity, op08_jaccard, op10_packing
from creditlake.llm.common import read, shared_dir
from creditlake.llm.op02_bpe import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold."""
    return op05_toxicity.drop_toxic(docs, op05_toxicity.train(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stay in another one."""
    return counted(op03_lines.drop_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return op08_jaccard.keep_representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes and more that also start elsewhere."""
    return counted(op04_suffixes.remove_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    return op10_packing.pack(docs, tokenizer_path("byte_bpe_50k.tiktoken"), ids=False)


def counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return docs.withColumn("n_chars", n) if "n_chars" in docs.columns else docs


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_duplicates", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("packing", pack),
]
#: SQL can express neither the trained model nor the Hilbert curve.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over all documents, each stage's rows written to the shared folder and read again."""
    import uuid

    docs, folder = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
