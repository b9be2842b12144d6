"""Prefix trie of conversations: nodes are distinct beginnings, with members, children, and totals over their subtrees.

``numbered``: turns are dealt by range of (conversation, turn), numbered where they lie and moved by the rows that earlier parts
have of their conversation, so that a conversation with very many turns is shared by many tasks. A turn goes on as a digest and a
length; texts are never exchanged. ``prefixes``: a node's key is the depth and 128 bits, the exclusive or of the hashes of all (place,
turn) so far, again by parts: within bands of ``height`` turns, then over the bands of a conversation.

``rolled_up``: depth is cut into bands of a fixed height. Within a band each node's figures go to itself and its ancestors there,
at most ``height`` rows, summed by ancestor. Bands are taken from the deepest up: the totals of a band's top nodes are complete then,
and are added to their parents in the band above. So there are depth / height rounds and a node makes at most ``height`` rows; the
height is HEIGHT or the root of the greatest depth, whichever is more, so neither grows faster than that root. Each round reads one
band's rows and writes its totals to the shared folder.

A digest of a node's members is taken in order of their ids: runs of at most 4,096 ids by id are gathered, and a task streams a
node's runs through the digest. That is one task a node, as SHA-256 has to be, but it holds one run at a time.

Defined cases: null roles and texts are empty; ties of a turn go by role, then by the digest of role and text; rows without a
conv_id belong to no conversation and are left out; other columns are ignored; an empty table gives no rows, not even the root.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditlake.llm.common import only, partitions, read, shared_dir, staged
from creditlake.llm.op11_runs import CRC32

#: Least height of a band.
HEIGHT = 32
KEY = ["depth", "a", "b"]
_RUN_BITS = 12


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn), said (digest of role and text), chars (code points of the text), of every turn."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    t = only(conversations, conv_id=conversations["conv_id"].cast("long"), turn=conversations["turn"], role=role, said=said, chars=F.length(text)).where("conv_id is not null")
    order = ["turn", "role", "said"]
    t = staged(t.repartitionByRange(partitions(t), "conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    parts = t.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return t.withColumn("here", here).join(parts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("here")).alias("pos"), "said", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of their hundred's first: turns (conv_id, depth, said, chars) and lengths (conv_id, depth)."""
    h = F.crc32(F.col("conv_id").cast("string")) % 6
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 100})
    bases = ids.where("conv_id = base").select("base", F.col("n").alias("base_n"))
    ids = ids.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_n", F.lit(0))))
    heads = turns.where("pos <= 5 and conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "pos", "said", "chars")
    led = ids.select("conv_id", "base", "h").join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "said", "chars")
    own = turns.withColumn("h", h).where("pos > h").join(ids.select("conv_id", "lead"), "conv_id").select("conv_id", (F.col("lead") + F.col("pos") - F.col("h")).alias("depth"), "said", "chars")
    return led.unionByName(own), ids.select("conv_id", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))


def prefixes(turns: DataFrame, height: int) -> DataFrame:
    """conv_id, chars, band, key of each beginning of a conversation, key of the one before it (up), path (keys from the band's top to it)."""
    t = turns.select("conv_id", "depth", "chars", F.floor((F.col("depth") - 1) / height).alias("band"), F.xxhash64("depth", "said").alias("x"), F.xxhash64("said", "depth", F.lit(1)).alias("y"))
    bands = t.groupBy("conv_id", "band").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select("conv_id", "band", *(F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("x", "y")))
    here = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(bands, ["conv_id", "band"]).withColumns({"a": F.col("x0").bitwiseXOR(F.bit_xor("x").over(here)), "b": F.col("y0").bitwiseXOR(F.bit_xor("y").over(here))})
    path = F.collect_list(F.struct("depth", "a", "b")).over(here)
    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("a").bitwiseXOR(F.col("x")).alias("a"), F.col("b").bitwiseXOR(F.col("y")).alias("b"))
    return t.select("conv_id", "chars", "band", *KEY, up.alias("up"), path.alias("path"))


def _by_band(nodes: DataFrame) -> DataFrame:
    """Written to the shared folder, a folder for each band, so that a round reads its own rows only."""
    spark = nodes.sparkSession
    path = f"{shared_dir(spark)}/bands-{uuid.uuid4().hex}"
    nodes.write.partitionBy("band").parquet(path)
    return spark.read.schema(nodes.schema).parquet(path)


def _keyed(column: str) -> list[Column]:
    return [F.col(f"{column}.{k}").alias(k) for k in KEY]


def rolled_up(nodes: DataFrame, bands: int) -> DataFrame:
    """Key, n_leaves, saved_tokens of each node over its subtree, the root left out. nodes: band, key, up, path, leaf, saved."""
    done, carried = None, None
    for band in range(bands - 1, -1, -1):
        here = nodes.where(F.col("band") == band)
        given = here.select("path", "leaf", "saved")
        if carried is not None:
            given = given.unionByName(carried.join(here.select(*KEY, "path"), KEY).select("path", "leaf", "saved"))
        totals = given.select(F.explode("path").alias("k"), "leaf", "saved").groupBy(*_keyed("k")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        totals = staged(totals, "band")
        tops = here.where(F.size("path") == 1).select(*KEY, "up").join(totals, KEY)
        carried = tops.groupBy(*_keyed("up")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        done = totals if done is None else done.unionByName(totals)
    return done


def ends_digests(ends: DataFrame) -> DataFrame:
    """Key, ends_sha256: digest of the ids of each node's conversations, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True))

        def digests() -> Iterator[tuple]:
            for key, group in itertools.groupby(rows, key=lambda r: r[:3]):
                digest = hashlib.sha256()
                for k, r in enumerate(group):
                    digest.update(f"{',' if k else ''}{r[3]}".encode())
                yield *key, digest.hexdigest()

        for part in itertools.batched(digests(), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], [*KEY, "ends_sha256"])

    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = ends.groupBy(*KEY, F.shiftright("conv_id", _RUN_BITS).alias("run")).agg(ids.alias("ids"))
    return runs.repartition(partitions(runs), *KEY).sortWithinPartitions(*KEY, "run").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, height: int | None = None) -> DataFrame:
    """One row for each node. turns: conv_id, depth (from 1), said, chars; lengths: conv_id, depth (its number of turns) of every conversation."""
    lengths = staged(lengths.select("conv_id", F.col("depth").cast("long").alias("depth")), "lengths")
    n, least, most = lengths.agg(F.count(F.lit(1)), F.min("conv_id"), F.coalesce(F.max("depth"), F.lit(0))).first()
    height = height or max(HEIGHT, math.isqrt(most))
    members = staged(prefixes(turns.withColumn("depth", F.col("depth").cast("long")), height), "prefixes")
    grouped = members.groupBy(*KEY, "band").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max("up").alias("up"), F.max("path").alias("path"))
    grouped = staged(grouped, "nodes")
    children = staged(grouped.groupBy(*_keyed("up")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0)
    spark = turns.sparkSession
    nodes = grouped.join(children, KEY, "left").withColumns({"leaf": leaf.cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")})
    nodes = _by_band(nodes)
    totals = rolled_up(nodes, max(1, -(-most // height)))
    root = spark.range(1).where(F.lit(n) > 0).select(*(F.lit(0).cast("long").alias(k) for k in KEY), F.lit(least).cast("long").alias("conv_id"), F.lit(n).cast("long").alias("n_convs"))
    first = totals.where("depth = 1").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.count(F.lit(1)).alias("n_children"))
    root = root.join(F.broadcast(first)).select(*KEY, "conv_id", "n_convs", F.coalesce("leaf", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), "n_children", F.lit(None).cast("long").alias("parent_conv_id"))
    parents = nodes.select(F.struct(*KEY).alias("up"), F.col("conv_id").alias("above"))
    below = nodes.select(*KEY, "conv_id", "n_convs", "n_children", "up").join(totals, KEY).join(parents, "up", "left")
    above = F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.col("above"))
    below = below.select(*KEY, "conv_id", "n_convs", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("n_children", F.lit(0)).alias("n_children"), above.alias("parent_conv_id"))
    last = members.join(lengths, ["conv_id", "depth"]).select(*KEY, "conv_id")
    turnless = lengths.where("depth = 0").select(*(F.lit(0).cast("long").alias(k) for k in KEY), "conv_id")
    out = root.unionByName(below).join(ends_digests(last.unionByName(turnless)), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(staged(numbered(read(spark, sf_dir, "conversations")), "numbered")))


SQL = f"""
WITH c AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (
  SELECT *, {CRC32.format("conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id)),
ids AS (
  SELECT o.*, least(o.h, coalesce(b.n, 0)) AS lead FROM own o LEFT JOIN own b ON b.conv_id = o.base),
turns AS (
  SELECT i.conv_id, c.pos AS depth, role, text FROM ids i JOIN c ON c.conv_id = i.base AND c.pos <= i.h
  UNION ALL SELECT i.conv_id, i.lead + c.pos - i.h, role, text FROM ids i JOIN c ON c.conv_id = i.conv_id AND c.pos > i.h),
p AS (
  SELECT conv_id, depth, length(text) AS chars, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
node AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM p GROUP BY k, depth),
link AS (
  SELECT DISTINCT x.k, y.k AS up FROM p x JOIN p y ON x.conv_id = y.conv_id AND y.depth = x.depth - 1),
children AS (
  SELECT up, count(*) AS n FROM link GROUP BY up),
under AS (
  SELECT DISTINCT y.k AS top, x.k FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.depth >= y.depth),
subtree AS (
  SELECT top, count(*) FILTER (n IS NULL) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM under JOIN node USING (k) LEFT JOIN children ON children.up = under.k GROUP BY top),
ends AS (
  SELECT k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) USING (conv_id, depth) GROUP BY k)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(children.n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(members, '')) AS ends_sha256
FROM node LEFT JOIN link USING (k) LEFT JOIN node above ON above.k = link.up LEFT JOIN children ON children.up = node.k JOIN subtree ON subtree.top = node.k LEFT JOIN ends ON ends.k = node.k
"""
