"""Toxicity: a factorization machine over hashed terms.

The model is fitted in one task on at most ``sample`` labelled rows (those of smallest hash, so the sample is the same at every
run). Every term, a word or the beginning of one, is hashed to one of BUCKETS buckets and none is left out. The machine learns a
weight for each and, by a short vector for each, what pairs of them add, such as an insult and whom it is aimed at. How well a
bucket tells the labels apart (log-likelihood ratio) sets how fast its weight moves; vectors of frequent buckets move without that,
so a term that says nothing alone still counts in a pair. Scores are made probabilities (Platt) on the FOLD-th part of the rows, by
a model of the others; the model that scores is fitted on all. Scoring goes over every whole text in parallel, one sparse product a
batch, and needs no exchange.

Defined cases: null text is the empty text, scored by the bias alone; a null doc_id isn't held out and is never learnt from; of rows
that repeat a labelled doc_id with several texts, the one of the least text hash is learnt from; labels that are null are left out;
with no labels, or labels of one kind, every score is the smoothed share of toxic labels; rows that repeat are scored each; other
columns pass through ``score`` (its own columns replace those of the same name).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm.common import map_batches, only, read, small_batches, text_of

SAMPLE = 20_000  #: labelled rows that are learnt from, at most
BUCKETS, FACTORS, FOLD = 1 << 18, 2, 4
#: A bucket of ratio r moves at (r / (r + HALF)) ** STEEP of the full rate, at LEAST of it at least; vectors of one in a share x of the
#: documents at PAIR * x / (x + HALF_SHARE) of it at least.
HALF, STEEP, LEAST, PAIR, HALF_SHARE = 6.0, 4, 0.001, 1.0, 0.5
STEPS, RATE, DECAY = 40, 0.1, 5e-5
THRESHOLD = 0.7
#: Code points of a word's beginnings that are terms of their own.
BEGINNINGS = (5, 6)
_MARKS = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)


def terms(text: str) -> np.ndarray:
    """Buckets, sorted, of the distinct lower-cased words of a whole text, ASCII marks cut off, and of the beginnings of longer words."""
    words = set(text.lower().encode().translate(_MARKS).decode().split())
    begun = {w[:n] for n in BEGINNINGS for w in words if len(w) > n}
    hashes = [xxhash.xxh3_64_intdigest(w) for w in words] + [xxhash.xxh3_64_intdigest(w, 1) for w in begun]
    return np.unique(np.array(hashes, np.uint64) & np.uint64(BUCKETS - 1)).astype(np.int64)


class _Sums:
    """Sums of values by groups of places, some of them empty."""

    def __init__(self, places: np.ndarray, sizes: np.ndarray):
        self.places, self.full = places, sizes > 0
        self.starts = (np.cumsum(sizes) - sizes)[self.full]

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.full), values.dtype)
        if len(self.starts):
            out[self.full] = np.add.reduceat(values[self.places], self.starts)
        return out


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray  #: of all buckets
    factors: np.ndarray  #: (BUCKETS, FACTORS)

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        by_doc = _Sums(np.concatenate([*docs, np.zeros(0, np.int64)]), np.array([len(d) for d in docs], np.int64))
        v = self.factors.astype(float)
        return self.bias + by_doc(self.weights - 0.5 * (v * v).sum(1)) + 0.5 * sum(by_doc(k) ** 2 for k in v.T)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(docs), -30, 30)))


def ratios(a: np.ndarray, n: np.ndarray, pos: float, total: int) -> np.ndarray:
    """Log-likelihood ratios of terms that are in n documents, a of them toxic."""

    def part(k: np.ndarray, of: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(k, 1e-9) / np.maximum(of, 1e-9))

    return np.maximum(0, 2 * (part(a, n * pos / total) + part(n - a, n * (total - pos) / total) + part(pos - a, (total - n) * pos / total) + part(total - n - pos + a, (total - n) * (total - pos) / total)))


def _machine(docs: list[np.ndarray], y: np.ndarray) -> Model:
    """Full-batch Adam on the logistic loss over the buckets that occur."""
    base = (y.sum() + 1) / (len(y) + 2)
    weights, factors = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, FACTORS), np.float32)
    sizes = np.array([len(d) for d in docs], np.int64)
    if not 0 < y.sum() < len(y) or not sizes.sum():
        return Model(float(np.log(base / (1 - base))), weights, factors)
    names, back, n = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
    m, row = len(names), np.repeat(np.arange(len(docs)), sizes)
    by_doc, by_term = _Sums(back, sizes), _Sums(row[np.argsort(back, kind="stable")], n)
    r = ratios(np.bincount(back, y[row], m), n, y.sum(), len(y))
    scale = np.maximum((r / (r + HALF)) ** STEEP, LEAST).astype(np.float32)
    scale = np.concatenate([[1], scale, np.tile(np.maximum(scale, PAIR * n / (n + HALF_SHARE * len(y))), FACTORS)]).astype(np.float32)
    decay = np.concatenate([[0], np.full(m, DECAY), np.full(m * FACTORS, 5 * DECAY)]).astype(np.float32)
    p = np.concatenate([[np.log(base / (1 - base))], np.zeros(m), np.random.default_rng(7).normal(0, 0.02, m * FACTORS)]).astype(np.float32)
    first, second, y = np.zeros_like(p), np.zeros_like(p), y.astype(np.float32)
    for t in range(1, STEPS + 1):
        q = p * scale
        w, v = q[1 : 1 + m], q[1 + m :].reshape(FACTORS, m)
        xv = [by_doc(k) for k in v]
        z = q[0] + by_doc(w - 0.5 * (v * v).sum(0)) + 0.5 * sum(k * k for k in xv)
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        gw = by_term(g)
        grad = np.concatenate([[g.sum()], gw, *(by_term(g * k) - u * gw for k, u in zip(xv, v, strict=True))]).astype(np.float32) * scale + decay * p
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        p = p - RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    q = p * scale
    weights[names], factors[names] = q[1 : 1 + m], q[1 + m :].reshape(FACTORS, m).T
    return Model(float(q[0]), weights, factors)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make logits probabilities of smoothed labels."""
    pos, neg = y.sum(), len(y) - y.sum()
    want, x, at = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2)), np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        at = at - np.clip(np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(2), x.T @ (p - want)), -0.5, 0.5)
    return max(0.1, float(at[0])), float(at[1])


def fit(docs: list[np.ndarray], y: np.ndarray) -> Model:
    """A model of all terms; the same rows in the same order give the same model up to rounding."""
    fold = np.arange(len(y)) % FOLD == 0
    model = _machine(docs, y)
    if not (0 < y[fold].sum() < fold.sum() and 0 < y[~fold].sum() < (~fold).sum()):
        return model
    part = _machine([d for d, f in zip(docs, fold, strict=True) if not f], y[~fold])
    slope, offset = _platt(part.logits([d for d, f in zip(docs, fold, strict=True) if f]), y[fold])
    return Model(slope * model.bias + offset, model.weights * np.float32(slope), model.factors * np.float32(slope**0.5))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of the rows that aren't held out; at most ``sample`` of them go to the one task that fits it."""
    small_batches(documents.sparkSession)
    id_ = labels["doc_id"].cast("long")
    known = only(labels, doc_id=id_, toxic=labels["toxic"].cast("double")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = text_of(documents)
    texts = only(documents, doc_id=documents["doc_id"].cast("long"), digest=F.xxhash64(text), text=text)
    # One text for each labelled id, however many rows repeat it, before any is featurised or goes to the one task.
    rows = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "digest", "toxic"), "digest").alias("row")).select("doc_id", "row.*")

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [terms(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), b.column("toxic"), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "digest", "toxic", "terms"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for b in batches:
            for i, d, y, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "toxic")), b.column("terms").to_numpy(zero_copy_only=False), strict=True):
                if i not in found or d < found[i][0]:
                    found[i] = d, y, np.asarray(t, np.int64)
        rows_ = [found[i] for i in sorted(found)]
        model = fit([t for _, _, t in rows_], np.array([float(y > 0) for _, y, _ in rows_]))
        yield pa.RecordBatch.from_arrays([pa.array([model.bias], pa.float64()), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.factors.tobytes()], pa.binary())], ["bias", "weights", "factors"])

    features = map_batches(rows, featurise, "doc_id long, digest long, toxic double, terms array<long>")
    (m,) = features.repartition(1).mapInArrow(learn, "bias double, weights binary, factors binary").collect()
    return Model(m.bias, np.frombuffer(m.weights, np.float32), np.frombuffer(m.factors, np.float32).reshape(BUCKETS, FACTORS))


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """documents, all columns, with score and predicted under the names in ``into``."""
    small_batches(documents.sparkSession)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.scores([terms(t) for t in texts]), dtype=float)

    return documents.withColumn(into[0], scored(text_of(documents, text))).withColumn(into[1], (F.col(into[0]) >= threshold).cast("int"))


def drop_toxic(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """documents, all columns, without those that score the threshold or more."""
    rows = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"), text_of(documents).alias("text"))
    return score(rows, model, threshold).where(F.col("predicted") == 0).select("row.*")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    narrow = only(documents, doc_id=documents["doc_id"].cast("long"), text=text_of(documents))
    return score(narrow, train(documents, read(spark, sf_dir, "labels"))).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
