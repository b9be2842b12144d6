"""Connected components of an edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditlake.llm.common import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: each node links its larger neighbours to the least of its neighbourhood; else it links its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    met = both.join(least, both["a"] == least["n"])
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """a, b pairs → node, root: the least node that each node reaches; nodes without an edge have no row.

    The number of steps is logarithmic in the longest path; each step's edges are written to the shared folder, and only two
    numbers about them come to the driver.
    """
    edges = staged(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    state = None
    while True:
        edges = staged(_stars(_stars(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
