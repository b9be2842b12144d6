"""Nearest neighbours by cosine: an inverted file of coarse centroids with product-quantised residuals, and bounds that make it exact.

Equal vectors are indexed once with their smallest ids (a limit that Spark applies before it exchanges rows), so a vector that a
third of all rows share is one entry. Centroids and codebooks are fitted in one task on a bounded sample; every vector is indexed.
The first pass finds k near vectors of each query, of which nothing is assumed but that they are there: each list's size and spread
tell how many of its vectors are expected to be nearer than the k-th nearest of all, the lists that hold COVER of what is expected
are probed, asymmetric distance tables rank their codes, and the best RERANK are measured exactly. The second pass takes the k-th
score as a bound and loses nothing: a list is left out only if the angles from its centroid to the query and to its farthest vector
say that none of it can score so, a code only if the same holds of the vector that it stands for and its own error, and all others
are measured on the original vectors, in double precision. So results are those of brute force, whatever the rows are; the index
decides what they cost. Where vectors form clusters that is few lists; where they have no structure, as uniform directions, all
codes are looked at, and a few in a hundred of the vectors or, in many dimensions, all.
Lists are cut into blocks of bounded size, which are dealt to tasks by hash; in each pass a query goes once to each task that has
lists of it, and each entry to one task.

Defined cases: vectors that are null, zero, of another length than most, or with null or non-finite parts take no part; rows that
repeat an id and its vector count once; ties go to the smaller id; a null id takes no part; with fewer than k candidates all are
returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from creditlake.llm.common import only, partitions, read, staged

SAMPLE = 16_384  #: vectors that centroids and codebooks are fitted on, about; lists are a quarter of them at most
PARTS, CODES = 16, 256
#: Share of the expected nearest vectors that probed lists hold, lists that are probed at least, and vectors seen at least.
COVER, PROBES, LEAST = 0.97, 8, 256
RERANK, BLOCK, K, EVERY = 64, 4096, 5, 50
#: Queries that a task answers at once, pairs that it keeps before it drops all but the best, and numbers that it gathers at once.
ASKED, PAIRS, GATHER = 256, 1 << 20, 1 << 21
#: Rounding that bounds allow for: products with single-precision codes, with centroids, and of unit vectors in double precision.
CODED, CENTRED, ROUNDED = 1e-5, 1e-6, 1e-9


@dataclass(frozen=True)
class Index:
    coarse: np.ndarray  #: (lists, d), unit length
    books: np.ndarray  #: (parts, codes, d / parts)

    def near(self, unit: np.ndarray) -> np.ndarray:
        """Cosines with all centroids."""
        return unit @ self.coarse.T / self.norms

    @property
    def norms(self) -> np.ndarray:
        return np.maximum(np.linalg.norm(self.coarse.astype(np.float64), axis=1), 1e-12)

    def decoded(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for."""
        rest = self.books[np.arange(codes.shape[1]), codes].reshape(len(codes), -1).astype(np.float64)
        return self.coarse[lists] + rest[:, : self.coarse.shape[1]]

    def codes(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = _padded(unit - self.coarse[lists], self.books).astype(np.float32)
        return np.stack([_nearest(r, b) for r, b in zip(rest.transpose(1, 0, 2), self.books, strict=True)], 1).astype(np.uint8)


def _padded(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts, _, width = books.shape
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 8192] @ centres.T - half, 1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def fit(x: np.ndarray, lists: int, parts: int = PARTS) -> Index:
    """x: unit vectors."""
    rng = np.random.default_rng(5)
    coarse = kmeans(x.astype(np.float32), lists, 8, rng)
    coarse /= np.maximum(np.linalg.norm(coarse, axis=1, keepdims=True), 1e-12)
    parts = min(parts, x.shape[1])
    width = -(-x.shape[1] // parts)
    rest = _padded(x - coarse[_nearest(x.astype(np.float32), coarse)], np.zeros((parts, 1, width))).astype(np.float32)
    books = [kmeans(r, CODES, 6, rng) for r in rest.transpose(1, 0, 2)]
    return Index(coarse, np.stack([np.pad(b, ((0, min(CODES, len(x)) - len(b)), (0, 0))) for b in books]))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each row of x with q or its row, row by row, so that a value doesn't depend on the rows beside it."""
    x, q = x.astype(np.float64), q.astype(np.float64)
    return (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum(-1)))


def reachable(product: np.ndarray, score: np.ndarray, along: np.ndarray, across: np.ndarray, slack: float) -> np.ndarray:
    """Where a unit vector x may have this cosine with a query, by the triangle inequality of angles.

    product: of the query with a stand-in for x; along: of x with the stand-in; across: the stand-in's part that is perpendicular to x.
    """
    return (product >= along * score - across * np.sqrt(1 - score * score) - slack) | (along + np.hypot(along, across) * score < slack)


def classes(embeddings: DataFrame, keep: int) -> DataFrame:
    """vector, ids: each distinct vector that takes part, with its smallest ids."""
    v = only(embeddings, vec_id=embeddings["vec_id"].cast("long"), vector=embeddings["embedding"].cast("array<double>"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    size = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    v = v.where(F.size("vector") == (size[0].n if size else 0)).distinct()
    first = v.withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("rank") <= keep)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Its vectors, each times a power of two that keeps squares within range and no cosine changes by."""
    if not len(column):
        return np.zeros((0, 1))
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def train(rows: DataFrame, n: int) -> Index | None:
    """Fitted in one task on rows of small hash: SAMPLE of them in expectation, never more than twice as many."""
    lists = max(1, min(SAMPLE // 4, round(4 * math.sqrt(n))))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_matrix(b.column("vector")) for b in batches if b.num_rows]
        if found:
            x = unit(np.concatenate(found))
            index = fit(x[np.lexsort(x.T[::-1])], lists)
            yield pa.RecordBatch.from_arrays([pa.array([index.coarse.astype("<f4").tobytes()]), pa.array([index.books.astype("<f4").tobytes()]), pa.array([list(index.books.shape)], pa.list_(pa.int32()))], ["coarse", "books", "shape"])

    span = 1 << 30
    some = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("vector"), F.lit(span)) < int(span * SAMPLE / n)).limit(2 * SAMPLE)
    made = some.select("vector").repartition(1).mapInArrow(learn, "coarse binary, books binary, shape array<int>").collect()
    if not made:
        return None
    (m,) = made
    dim = len(rows.select("vector").first().vector)
    return Index(np.frombuffer(m.coarse, "<f4").reshape(-1, dim), np.frombuffer(m.books, "<f4").reshape(m.shape))


def tail(z: np.ndarray) -> np.ndarray:
    """Share of a normal distribution beyond z, within a few parts in a hundred."""
    high = 0.5 * np.exp(-0.717 * np.abs(z) - 0.416 * z * z)
    return np.where(z >= 0, high, 1 - high)


@dataclass(frozen=True)
class Spread:
    """Of each list: its size, and of the cosines of its vectors with the centroid the mean, the variance and the mean of 1 less the square."""

    held: np.ndarray
    mean: np.ndarray
    variance: np.ndarray
    rest: np.ndarray

    def expected(self, near: np.ndarray, dim: int, k: int) -> np.ndarray:
        """Of the k nearest vectors of each query, how many each list is expected to hold; near: cosines of queries and centroids."""
        middle = near * self.mean
        width = np.sqrt(near**2 * self.variance + np.maximum(0, 1 - near**2) * self.rest / max(1, dim - 1) + 1e-12)
        low, high = np.full((len(near), 1), -1.5), np.full((len(near), 1), 1.5)
        for _ in range(24):
            level = (low + high) / 2
            many = (self.held * tail((level - middle) / width)).sum(1, keepdims=True) > k
            low, high = np.where(many, level, low), np.where(many, high, level)
        return self.held * tail((low - middle) / width)

    def probed(self, near: np.ndarray, dim: int, k: int, cover: float) -> list[np.ndarray]:
        """The lists that each query probes."""
        out = []
        for want, cosines in zip(self.expected(near, dim, k), near, strict=True):
            order = np.lexsort((-cosines, -want))
            order = order[self.held[order] > 0]
            share = np.cumsum(want[order])
            enough = int(np.searchsorted(share, cover * share[-1])) + 1, int(np.searchsorted(np.cumsum(self.held[order]), LEAST)) + 1
            out.append(order[: max(PROBES, *enough)])
        return out


@dataclass(frozen=True)
class Held:
    """A task's entries in order of their blocks."""

    index: Index
    vectors: np.ndarray
    norms: np.ndarray
    lists: np.ndarray
    codes: np.ndarray  #: (parts, entries)
    along: np.ndarray  #: products of the vectors, as unit vectors, with what their codes stand for
    across: np.ndarray  #: and the part of that which is perpendicular to the vector
    ids: list[list[int]]
    lowest: np.ndarray
    edges: np.ndarray  #: where each of the task's blocks begins, and the end

    @staticmethod
    def of(index: Index, batches: list[pa.RecordBatch], own: np.ndarray) -> Held:
        t = pa.Table.from_batches(batches).combine_chunks()
        one = lambda name: t.column(name).combine_chunks()
        x, lists, ids = _matrix(one("vector")), one("list").to_numpy(), one("ids").to_pylist()
        codes = np.frombuffer(b"".join(one("code").to_pylist()), np.uint8).reshape(len(x), -1)
        norms = np.sqrt((x * x).sum(1))
        along, across = np.zeros(len(x)), np.zeros(len(x))
        for i in range(0, len(x), BLOCK):
            at = slice(i, i + BLOCK)
            u, coded = x[at] / norms[at, None], index.decoded(codes[at], lists[at])
            along[at] = (u * coded).sum(1)
            across[at] = np.linalg.norm(coded - along[at, None] * u, axis=1)
        edges = np.append(np.searchsorted(one("block").to_numpy(), own), len(x))
        return Held(index, x, norms, lists, np.ascontiguousarray(codes.T), along, across, ids, np.array([i[0] for i in ids]), edges)

    def first(self, q: np.ndarray, wanted: np.ndarray, count: int, rerank: int) -> tuple[np.ndarray, ...]:
        """Places of queries and of entries and their scores: of the ``rerank`` entries with the best codes in the wanted blocks the best."""
        found = []
        for i, (own, u) in enumerate(zip(q, unit(q).astype(np.float32), strict=True)):
            rows = np.concatenate([np.zeros(0, int), *(np.arange(self.edges[j], self.edges[j + 1]) for j in np.flatnonzero(wanted[i]))])
            near = (self.index.coarse @ u)[self.lists[rows]]
            for table, code in zip((self.index.books @ _padded(u[None], self.index.books)[0, :, :, None])[:, :, 0], self.codes, strict=True):
                near += table[code[rows]]
            if len(rows) > rerank:
                rows = rows[np.argpartition(-near, rerank)[:rerank]]
            found.append((np.full(len(rows), i), rows, cosine(self.vectors[rows], own)))
        return self.best(*map(np.concatenate, zip(*found, strict=True)), count)

    def rest(self, q: np.ndarray, wanted: np.ndarray, score: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
        """The same of all entries of the wanted blocks that score as much as is given for each query; -2 lets all in, as a cosine may round to less than -1."""
        u, norms = unit(q), np.sqrt((q * q).sum(1))
        least = np.clip(score, -1, 1)
        tables = (self.index.books @ _padded(u, self.index.books).transpose(1, 2, 0)).astype(np.float32)
        found, many = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))], 0
        for j in np.flatnonzero((self.edges[:-1] < self.edges[1:]) & wanted.any(0)):
            low, high, asks = self.edges[j], self.edges[j + 1], np.flatnonzero(wanted[:, j])
            near = np.repeat((u[asks] @ self.index.coarse[self.lists[low]])[None].astype(np.float32), high - low, 0)
            for table, code in zip(tables, self.codes[:, low:high], strict=True):
                near += table[code][:, asks] if 4 * len(asks) > len(q) else table[np.ix_(code, asks)]
            may = reachable(near, least[asks], self.along[low:high, None], self.across[low:high, None], CODED)
            if 8 * np.count_nonzero(may) > may.size:
                may &= self.vectors[low:high] @ u[asks].T / self.norms[low:high, None] >= least[asks] - ROUNDED
            rows, at = np.nonzero(may)
            rows, at, step = rows + low, asks[at], max(1, GATHER // q.shape[1])
            for i in range(0, len(rows), step):
                r, a = rows[i : i + step], at[i : i + step]
                exact = (self.vectors[r] * q[a]).sum(1) / (self.norms[r] * norms[a])  # as cosine has it
                enough = exact >= score[a] - ROUNDED
                found.append((a[enough], r[enough], exact[enough]))
                many += len(found[-1][0])
            if many > PAIRS:
                found = [self.best(*map(np.concatenate, zip(*found, strict=True)), count)]
                many = len(found[0][0])
        return self.best(*map(np.concatenate, zip(*found, strict=True)), count)

    def best(self, asks: np.ndarray, rows: np.ndarray, scores: np.ndarray, count: int) -> tuple[np.ndarray, ...]:
        """The first ``count`` of each query by score and smallest id."""
        order = np.lexsort((self.lowest[rows], -scores, asks))
        asks, rows, scores = asks[order], rows[order], scores[order]
        top = np.arange(len(asks)) - np.searchsorted(asks, asks) < count
        return asks[top], rows[top], scores[top]


def search(embeddings: DataFrame, every: int = EVERY, k: int = K, cover: float = COVER, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by ``every``; cover and rerank: of the first pass."""
    spark = embeddings.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    rows = staged(classes(embeddings, k + 1), "vectors")
    n = rows.count()
    index = train(rows, n) if n else None
    if index is None:
        return spark.createDataFrame([], out)
    dim, parts = index.coarse.shape[1], partitions(rows)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(_matrix(b.column("vector")))
                at = _nearest(x.astype(np.float32), index.coarse)
                codes = index.codes(x, at)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array((x * index.coarse[at]).sum(1) / index.norms[at]), pa.array([c.tobytes() for c in codes], pa.binary()), b.column("vector"), b.column("ids")], ["list", "cosine", "code", "vector", "ids"])

    entries = staged(rows.mapInArrow(indexed, "list int, cosine double, code binary, vector array<double>, ids array<long>"), "index")
    c = F.col("cosine")
    sizes = {r.list: r for r in entries.groupBy("list").agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.avg(1 - c * c).alias("rest"), F.min(c).alias("least")).collect()}  # a row a list, SAMPLE / 4 at most
    held, mean, variance, rest, least = (np.array([float(sizes[i][f]) if i in sizes else 0.0 for i in range(len(index.coarse))]) for f in ("n", "mean", "variance", "rest", "least"))
    spread, least = Spread(held, mean, variance, rest), np.clip(least, -1, 1)
    blocks = np.maximum(1, -(-spread.held.astype(int) // BLOCK))
    first = np.cumsum(blocks) - blocks  # the number of each list's first block
    task = np.random.default_rng(3).permutation(int(blocks.sum())) % parts
    list_of = np.repeat(np.arange(len(blocks)), blocks)
    dealt = np.split(np.argsort(task, kind="stable"), np.cumsum(np.bincount(task, minlength=parts))[:-1])  # each task's blocks

    def likely(near: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(near.shape, bool)
        for i, probed in enumerate(spread.probed(near, dim, k, cover)):
            out[i, probed] = True
        return out

    def possible(near: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
        score = np.clip(b.column("score").to_numpy(zero_copy_only=False), -1, 1)
        return (spread.held > 0) & reachable(near, score[:, None], least, np.sqrt(1 - least * least), CENTRED)

    def asking(chosen: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Each query for each task that has lists which are chosen, with a bit for each of the task's blocks."""
            for b in (b.slice(i, ASKED) for b in batches for i in range(0, b.num_rows, ASKED)):
                lists = chosen(index.near(unit(_matrix(b.column("vector")))), b)
                for t, own in enumerate(dealt):
                    wanted = lists[:, list_of[own]]
                    at = np.flatnonzero(wanted.any(1))
                    if len(at):
                        bits = pa.array([w.tobytes() for w in np.packbits(wanted[at], axis=1)], pa.binary())
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at)) for c in ("query_id", "vector", "score")), pa.array([t] * len(at), pa.int32()), bits], ["query_id", "vector", "score", "task", "wanted"])

        return ask

    asked = only(embeddings, query_id=embeddings["vec_id"].cast("long"), vector=embeddings["embedding"].cast("array<double>")).where(F.col("query_id") % every == 0)
    asked = asked.join(rows.select("vector"), "vector", "left_semi").distinct()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each entry with its block, by the place in its task's batch; balance is all that depends on it."""
        turn = 0
        for b in batches:
            at = b.column("list").to_numpy()
            block = first[at] + (np.arange(len(at)) + turn) % blocks[at]
            turn += len(at)
            yield pa.RecordBatch.from_arrays([pa.array(task[block], pa.int32()), pa.array(block, pa.int32()), b.column("list"), b.column("code"), b.column("vector"), b.column("ids")], ["task", "block", "list", "code", "vector", "ids"])

    placed_ = entries.select("list", "code", "vector", "ids").mapInArrow(placed, "task int, block int, list int, code binary, vector array<double>, ids array<long>")

    def answered(asks: DataFrame, chosen: Callable, answers: Callable) -> DataFrame:
        """The k best of what ``answers`` finds for each query in the tasks that have lists which are chosen."""
        asks = asks.select("query_id", "vector", "score").mapInArrow(asking(chosen), "query_id long, vector array<double>, score double, task int, wanted binary")
        both = placed_.unionByName(asks, allowMissingColumns=True).repartitionById(parts, F.col("task")).sortWithinPartitions(F.col("query_id").asc_nulls_first(), "block")

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A task's entries, sorted by block, then the queries that ask for some of its blocks."""
            kept: list[pa.RecordBatch] = []
            held: Held | None = None
            for b in batches:
                entry = b.filter(b.column("query_id").is_null())
                if entry.num_rows:
                    kept.append(entry)
                asks = b.filter(b.column("query_id").is_valid())
                if not asks.num_rows or not kept:
                    continue
                own = dealt[asks.column("task")[0].as_py()]
                held = held or Held.of(index, kept, own)
                for part in (asks.slice(i, ASKED) for i in range(0, asks.num_rows, ASKED)):
                    wanted = np.unpackbits(np.frombuffer(b"".join(part.column("wanted").to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1, count=len(own)).astype(bool)
                    at, found, scores = answers(held, _matrix(part.column("vector")), wanted, part.column("score").to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(at)), pa.array([held.ids[r] for r in found.tolist()], pa.list_(pa.int64())), pa.array(scores)], ["query_id", "ids", "score"])

        found = both.mapInArrow(answer, "query_id long, ids array<long>, score double")
        found = found.select("query_id", F.explode("ids").alias("vec_id"), "score").where(F.col("vec_id") != F.col("query_id"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    some = answered(asked.withColumn("score", F.lit(-2.0)), likely, lambda held, q, wanted, score: held.first(q, wanted, k + 1, rerank))
    bound = asked.join(some.where(F.col("rank") == k).select("query_id", "score"), "query_id", "left").withColumn("score", F.coalesce("score", F.lit(-2.0)))
    return answered(bound, possible, lambda held, q, wanted, score: held.rest(q, wanted, score, k + 1)).select("query_id", "rank", "vec_id", "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
