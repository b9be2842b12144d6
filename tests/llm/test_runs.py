"""Periodic runs against brute force."""

import random

import pytest

from creditlake.llm import op11_runs as R
from tests.oracle import agrees


def brute(w, least=6, times=4):
    n, best = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                best[i, j - i + q] = min(q, best.get((i, j - i + q), n))
            i = max(j, i + 1)
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def text(rng, most):
    n, k = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5])
    w = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
    if n and rng.random() < 0.5:
        a = rng.randrange(n)
        w = w[:a] + (w[a : a + 1 + rng.randrange(max(1, (n - a) // 3))] * n)[: n - a]
    if n > 10 and rng.random() < 0.3:
        w[rng.randrange(n)] = b"z"
    return w


@pytest.mark.parametrize(("usual", "pairs"), [(8192, 1 << 20), (16, 64)])
def test_runs_are_those_of_brute_force(monkeypatch, usual, pairs):
    monkeypatch.setattr(R, "USUAL", usual)
    monkeypatch.setattr(R, "PAIRS", pairs)
    R._usual.cache_clear()
    rng = random.Random(usual)
    for _ in range(800):
        w = text(rng, 120)
        assert [tuple(r) for r in R.runs(w).tolist()] == brute(w), w
    R._usual.cache_clear()


def test_extensions_are_those_of_brute_force():
    rng, np = random.Random(2), R.np
    for _ in range(100):
        n, k = rng.randint(2, 90), rng.choice([1, 2, 4])
        w = np.array([1 + rng.randrange(k) for _ in range(n)])
        pairs = [(i, j) for i in range(n + 1) for j in range(i + 1, n + 1)]
        got = R.Lce(w)(*np.array(pairs).T)
        for (i, j), x in zip(pairs, got.tolist(), strict=True):
            m = 0
            while j + m < n and w[i + m] == w[j + m]:
                m += 1
            assert x == m


def test_long_texts_of_one_word_and_of_long_periods():
    assert R.runs([b"a"] * 100_000).tolist() == [[0, 100_000, 1]]
    assert R.runs([b"%d" % (i % 20_000) for i in range(100_000)]).tolist() == [[0, 100_000, 20_000]]


def test_query_agrees_with_sql(spark, sf):
    agrees(R.op11_periodic_runs(spark, sf), R.SQL, sf)


def test_odd_rows_and_other_columns(spark):
    said = "x " + "la " * 7 + "end"
    rows = [(1, said, "r"), (1, said, None), (None, "a b " * 4, "r"), (3, None, "r"), (4, "", "r"), (5, "no run\nhere\x0b", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = {(r.doc_id, r.collapsed): [tuple(x) for x in r.runs] for r in R.periodic_runs(df).collect()}
    assert got == {(1, "x la end"): [(1, 7, 1)], (None, "a b"): [(0, 8, 2)], (3, ""): [], (4, ""): [], (5, "no run here"): []}
    kept = sorted((r.doc_id or 0, r.text, r.runs) for r in R.collapse_runs(df).collect() if r.text is not None and r.doc_id != 1)
    assert kept == [(0, "a b", "r"), (4, "", "r"), (5, "no run\nhere\x0b", "r")]
    assert R.collapse_runs(df).columns == df.columns and R.collapse_runs(df).where("text is null").count() == 1
    assert R.run_digests(df.limit(0), R.planted).count() == 0
    empty = R.run_digests(df.where("doc_id = 3"), R.planted).first()
    assert empty.n_runs == 0 and empty.start is None and empty.exponent_milli is None and empty.runs_sha256 == empty.collapsed_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
