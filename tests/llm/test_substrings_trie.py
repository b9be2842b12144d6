"""Substring dedup and the prefix trie against SQL and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from creditlake.llm import op12_substrings as S
from creditlake.llm import op13_trie as T
from tests.oracle import agrees


def brute_spans(texts, window):
    """For each text the words that repeated windows cover."""
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    return [{i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)} for w in texts]


def mixed(rng, n):
    """Texts of few words that share passages, some of them often and in many surroundings."""
    common = [rng.choice("abcdefgh") * 3 for _ in range(60)]
    texts = []
    for _ in range(n):
        w = [f"{rng.choice('pqrstuv')}{rng.randrange(50)}" for _ in range(rng.randrange(150))]
        for _ in range(rng.randrange(4)):
            a, at = rng.randrange(30), rng.randrange(len(w) + 1)
            w[at:at] = common[a : a + rng.randrange(5, 60)]
        texts.append(w)
        if rng.random() < 0.2:
            texts.append(list(w))
    return texts


def test_query_of_substrings_agrees_with_sql(spark, sf):
    agrees(S.op12_substring_dedup(spark, sf), S.SQL, sf)


@pytest.mark.parametrize(("hot", "held", "windows"), [(1000, 32 << 20, 200_000), (3, 2000, 40)])
def test_spans_are_those_of_brute_force_when_grams_are_frequent_and_little_is_held(spark, monkeypatch, hot, held, windows):
    texts = mixed(random.Random(hot), 120)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    anchors = S.repeated_anchors(S._texts(df), hot)
    assert anchors.where("exists(places, p -> p < 0)").count() > 0 or hot > 3
    packed = S._packed(S._texts(df)).join(anchors, ["doc_id", "digest"]).repartition(3)
    rows = defaultdict(list)
    monkeypatch.setattr(S, "HELD", held)
    monkeypatch.setattr(S, "HELD_WINDOWS", windows)
    for batch in S._pieces(7)(iter(packed.toArrow().to_batches(max_chunksize=9))):
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows[r[0]].append(r[1:])
    got = defaultdict(set)
    for block in rows.values():
        for doc, _, start, end in S.parsed(iter(block)):
            got[doc] |= set(range(start, end))
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, S.WINDOW)


def test_marks_of_a_gram_that_many_tasks_share(spark, monkeypatch):
    texts = mixed(random.Random(8), 60)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    t = S._texts(df)
    counts = Counter()
    for w in texts:
        for a in S.anchors(S.Hashes().of([x.encode() for x in w])):
            counts.update(a.gram.tolist())
    want = sum(n for n in counts.values() if n > 1), sum(n for n in counts.values() if n >= 4)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = S.repeated_anchors(t, 4).select(F.explode("places").alias("p")).agg(F.count("p"), F.count_if(F.col("p") < 0)).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert tuple(got) == want


def test_a_reference_knows_the_longest_match_elsewhere():
    rng = random.Random(4)
    for _ in range(60):
        pieces = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 5))]
        ref = S.Reference(pieces)
        at = [(p, i) for p in range(len(pieces)) for i in range(len(pieces[p]))]

        def match(x, y):
            a, b = pieces[x[0]][x[1] :], pieces[y[0]][y[1] :]
            return next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))

        longest = {x: max((match(x, y) for y in at if y != x), default=0) for x in at}
        assert all(ref.longest[ref.starts[p] + i] == longest[p, i] for p, i in at)
        repeated = ref.repeated(3)
        assert all(repeated[ref.starts[p] + i] == (longest[p, i] >= 3) for p, i in at)
        places, lengths = ref.factors()
        assert lengths.sum() == sum(map(len, pieces)) and all(n == max(1, ref.longest[x]) for x, n in zip(places, lengths, strict=True))


def test_substrings_of_odd_rows_and_other_columns(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"x {long}  y", "r"), (2, f"{long} z", None), (None, f"n {long}", "r"), (0, f"m {long}", "r"), (3, None, "r"), (4, "", "r"), (5, "too short\nto lose", "r"), (6, "q " + long.replace("w5", "v5"), "r"), (7, "same " * 40, "r"), (8, "same " * 35, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").select("*", *(F.lit("c").alias(c) for c in ("digest", "packed", "spans", "_doc", "gram")))
    out = S.remove_substrings(df)
    got = {(r.doc_id, r.row): r.text for r in out.collect()}
    assert out.columns == df.columns
    assert got[1, "r"] == "x y" and got[2, None] == "z" and got[None, "r"] == "n" and got[0, "r"] == "m" and got[3, "r"] is None
    assert got[4, "r"] == "" and got[5, "r"] == "too short\nto lose" and got[7, "r"] == got[8, "r"] == ""
    assert got[6, "r"] == "q " + long.replace("w5", "v5")  # 34 words are the same
    twice = spark.createDataFrame([(1, long), (1, long), (2, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in S.substring_digests(twice).collect()) == [(1, 40, 40), (1, 40, 40), (2, 2, 0)]
    assert S.substring_digests(df.limit(0)).count() == 0 and S.remove_substrings(df.limit(0)).count() == 0


def brute_trie(rows):
    """Nodes by definition. rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes[t[:d]].append(c)
    kids = defaultdict(list)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    out = []
    for k, members in nodes.items():
        under = [x for x in nodes if x[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(members) if len(made[c]) == len(k))
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in under if x)
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids[k]), sum(not kids[x] for x in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_of_the_trie_agrees_with_sql(spark, sf):
    agrees(T.op13_prefix_trie(spark, sf), T.SQL, sf)


def test_trie_of_odd_rows_is_that_of_brute_force_at_any_height(spark):
    rng = random.Random(6)
    rows = [(rng.choice([0, 1, 2, 3, 100, 101, 150, 201, 305, 4099, 8200]), rng.choice([None, 0, 1, 2, 3, 4, 5, 6]), rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])) for _ in range(60)]
    rows += [(7, i, "user", "la" if i % 2 else "lo") for i in range(70)] + [(8, i, "user", "la" if i % 2 else "lo") for i in range(50)] + [(None, 1, "user", "x"), (777, 0, "user", "x"), (901, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", F.lit("c").alias("depth"), F.lit("c").alias("a"), F.lit(1).alias("part"))
    want = brute_trie(rows)
    made = T.rebuilt(T.staged(T.numbered(df), "numbered"))
    for height in (None, 7, 24):
        assert sorted((tuple(r) for r in T.prefix_trie(*made, height=height).collect()), key=str) == want
    assert T.prefix_trie(*T.rebuilt(T.numbered(df.limit(0)))).count() == 0
    alone = T.prefix_trie(*T.rebuilt(T.numbered(df.where("conv_id = 777")))).collect()
    assert sorted((tuple(r) for r in alone), key=str) == brute_trie([r for r in rows if r[0] == 777])
