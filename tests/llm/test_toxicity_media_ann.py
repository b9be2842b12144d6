"""Toxicity on held-out labels, media round trips, nearest neighbours against brute force."""

import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditlake.llm import op05_toxicity as T
from creditlake.llm import op06_media as M
from creditlake.llm import op07_ann as A


def one(word):
    return int(T.terms(word)[0])


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(1)
    words = {w: one(w) for w in ("rude", "folk", *(f"w{i}" for i in range(30)))}
    docs, y = [], []
    for _ in range(1500):
        x = {w for w in ("rude", "folk") if rng.random() < 0.5} | {f"w{rng.integers(30)}" for _ in range(4)}
        docs.append(np.array(sorted(words[w] for w in x)))
        y.append(float({"rude", "folk"} <= x))
    m = T.fit(docs, np.array(y))
    score = lambda *w: float(m.scores([np.array([words[x] for x in w])])[0])
    assert score("rude", "folk") > 0.7 > 0.3 > max(score("rude"), score("folk"), score("w1"))


def test_terms_that_tell_nothing_alone_are_learnt_in_pairs():
    rng = np.random.default_rng(6)
    words = [one(f"w{i}") for i in range(400)]
    docs, y = [], []
    for _ in range(4000):
        x = {words[i] for i in rng.integers(2, 400, 12)}
        both = rng.random(2) < 0.5
        docs.append(np.array(sorted(x | {w for w, b in zip(words, both) if b})))
        y.append(float(both[0] == both[1]))
    y = np.array(y)
    m = T.fit(docs[:3000], y[:3000])
    assert ((m.scores(docs[3000:]) >= 0.5) == y[3000:]).mean() >= 0.95


def test_scores_equal_a_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = T.Model(-0.5, rng.normal(0, 0.3, T.BUCKETS), rng.normal(0, 0.3, (T.BUCKETS, T.FACTORS)))
    docs = [T.terms(" ".join(f"word{k}" for k in rng.integers(0, 99, n))) for n in (0, 1, 2, 9, 30)] + [T.terms("")]
    for d, got in zip(docs, m.logits(docs), strict=True):
        want = m.bias + sum(m.weights[i] for i in d) + sum(float(m.factors[i] @ m.factors[j]) for k, i in enumerate(d) for j in d[:k])
        assert abs(got - want) < 1e-9


def test_of_repeated_ids_the_same_text_is_learnt_from(spark):
    docs, labels = toxic_tables(spark)
    twice = docs.unionByName(docs.where("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" again"))))
    a, b = (T.train(twice.repartition(n).orderBy(F.rand(n)), labels) for n in (2, 5))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def toxic_tables(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(1500):
        bad = r.random() < 0.2
        w = [f"w{r.randrange(300)}" for _ in range(r.randrange(5, 60))] + ([r.choice(["idiot,", "Scum", "moron."]) for _ in range(3)] if bad else [])
        r.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame([*docs, (None, "idiot scum"), (5000, None), (5001, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = toxic_tables(spark)
    out = T.score(docs.withColumn("score", F.lit("clash")), T.train(docs, labels)).withColumn("held", T.held_out(F.col("doc_id")))
    assert out.count() == 1503
    assert [r.held for r in out.where("doc_id is null").collect()] == [False]
    assert {r.predicted for r in out.where("text is null or text = ''").collect()} == {0}
    got = out.join(labels, "doc_id").where("held and doc_id < 1500").collect()
    assert {r.doc_id for r in got} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1} and sum(r.predicted == r.toxic for r in got) >= 0.97 * len(got)


def test_documents_are_read_in_parallel(spark, monkeypatch):
    plans, frame = [], type(spark.range(0))
    monkeypatch.setattr(frame, "collect", lambda self, f=frame.collect: plans.append(self._jdf.queryExecution().logical().toString()) or f(self))
    T.train(*toxic_tables(spark))
    assert "Repartition 1, true" in plans[-1] and "Repartition 1, false" not in plans[-1]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    m = T.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in T.score(docs, m).collect()} == {0.5}
    assert T.score(docs.limit(0), m).count() == 0


@pytest.mark.parametrize("shape, kind", [((7, 5), np.uint8), ((4, 6, 3), np.uint8), ((3, 11), bool), ((1, 1), np.uint8)])
def test_media_round_trips(shape, kind):
    a = np.random.default_rng(2).integers(0, 2 if kind is bool else 256, shape).astype(kind)
    assert (M.decode(M.encode_netpbm(a)) == a).all()
    if kind is not bool:
        assert (M.decode(M.encode_bmp(a)) == a).all()
        with pytest.raises(M.MediaError):
            M.decode(M.encode_bmp(a)[:-5])
        with pytest.raises(M.MediaError):
            M.decode(M.encode_netpbm(a)[:-1])


def test_area_resize_is_the_mean_of_areas():
    a = np.random.default_rng(3).random((12, 18)) * 255
    assert np.allclose(M.area_resize(a, 4, 6), a.reshape(4, 3, 6, 3).mean((1, 3)))
    fine = np.kron(a, np.ones((5, 7)))  # every cut falls on an edge of the finer grid
    assert np.allclose(M.area_resize(a, 5, 7), fine.reshape(5, 12, 7, 18).mean((1, 3)))


def test_npy_tiles_hold_the_array():
    a = np.arange(50 * 70, dtype=np.uint16).reshape(50, 70)
    tiles = [np.load(io.BytesIO(t)) for t in M.npy_tiles(a)]
    assert (np.block([[*tiles[:3]], [*tiles[3:]]]) == a).all()


def test_broken_images_are_media_errors():
    a = np.arange(35, dtype=np.uint8).reshape(5, 7)
    whole = [M.encode_bmp(a), M.encode_netpbm(a), M.encode_netpbm(a > 9), M.encode_bmp(np.stack([a] * 3, 2)), M.encode_netpbm(np.stack([a] * 3, 2))]
    for data in whole:
        for n in range(len(data)):
            with pytest.raises(M.MediaError):
                M.decode(data[:n])
    for data in (b"", b"P5\n0 0\n255\n", b"P5\n2 2\n65535\n" + b"x" * 8, M.encode_bmp(a)[:18] + b"\0" * 8 + M.encode_bmp(a)[26:], b"BM" + b"\xff" * 60):
        with pytest.raises(M.MediaError):
            M.decode(data)


def naive_resize(a, h, w):
    """Means of areas from samples repeated until the areas are whole."""
    big = np.repeat(np.repeat(a.astype(float), h, 0), w, 1)
    return big.reshape(h, a.shape[0], w, a.shape[1]).mean((1, 3))


def test_hash_and_tiles_equal_naive_ones():
    rng = np.random.default_rng(5)
    for h, w in ((24, 24), (48, 24), (7, 5), (200, 24)):
        a = rng.integers(0, 256, (h, w)).astype(np.uint8)
        small = naive_resize(a, 8, 9)
        bits = [bool(small[i, j] < small[i, j + 1] - 1e-7) for i in range(8) for j in range(8)]
        assert M.difference_hash(a) == int("".join(map(str, map(int, bits))), 2)
        full = np.round(naive_resize(a, 64, 64) + 1e-9).astype(np.uint8)
        tiles = [full[i : i + 32, j : j + 32] for i in (0, 32) for j in (0, 32)]
        got = [np.load(io.BytesIO(t)) for t in M.npy_tiles(np.round(M.area_resize(a, 64, 64)).astype(np.uint8))]
        assert all(np.abs(x.astype(int) - y).max() <= 1 for x, y in zip(got, tiles, strict=True)) and sum(int((x != y).sum()) for x, y in zip(got, tiles, strict=True)) <= 4


def test_media_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "é" * 500, 3), (3, "é" * 500, 3)], "doc_id long, text string, feature int")
    got = {r.doc_id: r for r in M.media_digests(df).collect()}
    pad = b"\xff" * 576
    assert (got[1].n_bytes, got[1].payload_bytes, got[1].payload_sha256, got[1].tail_crc32) == (0, 576, hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-32:]))
    assert got[None][1:] == got[3][1:] and got[3].payload_bytes == 1152
    assert M.media_tiles(df).count() == 16 and M.media_digests(df.limit(0)).count() == 0


def brute(rows, every, k):
    seen = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and all(np.isfinite(v)) and any(v)}
    ids, x = [s[0] for s in seen], np.array([s[1] for s in seen], float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            s = u @ u[q]
            out[ids[q]] = [i for _, i in sorted((-round(float(s[j]), 9), ids[j]) for j in range(len(ids)) if ids[j] != ids[q])[:k]]
    return out


def test_neighbours_with_hot_and_bad_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16)]) for i in range(1200)]
    rows += [(2000 + i, rows[0][1]) for i in range(400)] + [rows[5], rows[50]]
    bad = [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [1.0] * 3), (None, [1.0] * 16), (3200, [None] * 16)]
    df = spark.createDataFrame([(*r, "clash") for r in rows + bad], "vec_id long, embedding array<float>, score string").repartition(5)
    got = {}
    for r in A.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(rows, 50, 5)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5]
        assert [(-round(s, 9), i) for _, i, s in sorted(found)] == sorted((-round(s, 9), i) for _, i, s in found)
    assert sum(len({i for _, i, _ in got[q]} & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    assert [i for _, i, _ in sorted(got[2050])] == [0, 2000, 2001, 2002, 2003]


def test_clustered_vectors_need_few_lists():
    rng = np.random.default_rng(2)
    u = A.unit(rng.normal(size=(200, 48))[rng.integers(0, 200, 8000)] + 0.3 * rng.normal(size=(8000, 48)))
    index = A.fit(u, 4 * round(8000**0.5))
    at = A._nearest(u.astype(np.float32), index.coarse)
    c, n = (u * index.coarse[at]).sum(1), np.bincount(at, minlength=len(index.coarse)).astype(float)
    mean = lambda x: np.bincount(at, x, len(n)) / np.maximum(n, 1)
    probed = A.Spread(n, mean(c), np.maximum(0, mean(c * c) - mean(c) ** 2), mean(1 - c * c)).probed(u[::100] @ index.coarse.T, 48, 5, A.COVER)
    near = u[::100] @ u.T
    near[np.arange(80), np.arange(80) * 100] = -2
    best = np.argsort(-near, 1)[:, :5]
    assert np.mean([n[p].sum() for p in probed]) < 0.12 * len(u)
    assert np.mean([np.isin(at[b], p).mean() for b, p in zip(best, probed, strict=True)]) >= 0.95


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in A.search(df).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert A.search(df.limit(0)).count() == 0


def ranked(ids, x, every, k):
    """Of each query the k nearest, by brute force on vectors that are scaled to where squares stay finite; ties go by id."""
    x = x / np.abs(x).max(1, keepdims=True)
    n = np.sqrt((x * x).sum(1))
    return {int(ids[q]): [int(ids[i]) for i in np.lexsort((ids, -np.round((x * x[q]).sum(1) / (n * n[q]), 13))) if i != q][:k] for q in range(len(ids)) if ids[q] % every == 0}


SHAPES = {
    "near copies": lambda g: g.normal(size=(2, 24))[g.integers(0, 2, 1500)] + 1e-3 * g.normal(size=(1500, 24)),
    "one direction": lambda g: 9 + g.normal(size=(1500, 24)),
    "many dimensions": lambda g: g.normal(size=(1200, 400)),
    "copies beside none": lambda g: np.concatenate([g.normal(size=24) + 1e-2 * g.normal(size=(700, 24)), g.normal(size=(700, 24))]),
    "far scales": lambda g: (g.normal(size=(1, 8)) + 0.01 * g.normal(size=(1000, 8))) * 10.0 ** g.choice([-250, 0, 250], (1000, 1)),
    "one number": lambda g: g.choice([-1.0, 1.0], (900, 1)) * np.arange(1, 901)[:, None],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_no_nearest_vector_is_missed(spark, shape):
    x = SHAPES[shape](np.random.default_rng(4))
    ids = np.random.default_rng(5).permutation(len(x))
    got = {}
    for r in A.search(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [i for _, i in sorted(f)] for q, f in got.items()} == ranked(ids, x, 50, 5)


def test_few_vectors_that_are_all_opposite(spark):
    x = np.random.default_rng(1).normal(size=(400, 7))
    x = x[A.cosine(-3 * x, x) < -1][0]  # rounded
    df = spark.createDataFrame([(i, (f * x).tolist()) for i, f in enumerate((1, -3, -6, -1))], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in A.search(df).collect()} == {1, 2, 3}


def test_bounds_leave_out_no_vector_that_scores_enough():
    g = np.random.default_rng(6)
    for d, off in ((2, 0.3), (3, 1.0), (24, 0.5), (24, 1e-6), (1, 0.7)):
        x, q = A.unit(g.normal(size=(300, d))), A.unit(g.normal(size=(200, d)))
        coded = g.uniform(0, 2, (300, 1)) * x + off * g.normal(size=(300, d))
        along = (x * coded).sum(1)
        across = np.linalg.norm(coded - along[:, None] * x, axis=1)
        for score in (-1.0, -0.6, 0.0, 0.8, 1.0):
            may = A.reachable(coded @ q.T, np.array(score), along[:, None], across[:, None], A.ROUNDED)
            assert may[x @ q.T >= score].all()
    assert not A.reachable(np.array(0.1), np.array(0.9), np.array(1.0), np.array(0.1), A.ROUNDED)
