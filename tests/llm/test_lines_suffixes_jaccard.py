"""Line dedup, repeated strings and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from creditlake.llm import op03_lines as L
from creditlake.llm import op04_suffixes as X
from creditlake.llm import op08_jaccard as J
from tests.oracle import agrees

DOCS = "doc_id long, text string"


def test_lines_agree_with_sql(spark, sf):
    agrees(L.op3_line_dedup(spark, sf), L.SQL, sf)


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    rank = lambda d: -1 if d is None else d
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held.get(key(x), ())) < 5 or d == max(held[key(x)], key=rank)]
        out.append((d, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_with_odd_rows_in_any_partitioning(spark):
    a, b, c = "Shared line that is forty characters long, at least", "é" * 40, "x" * 39
    rows = [(d, f"{a}\n  {b.upper() if d % 2 else b} \nown {d}\n{a.upper()}\n{c}") for d in range(40)] + [(None, a), (7, a), (7, f"{a}\nz"), (50, None), (51, ""), (39, f"{a}"), (52, f"{b}\n" * 3)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS + ", bits string")
    got = sorted((tuple(r) for r in L.line_digests(df).collect()), key=str)
    assert got == brute_lines(rows)
    kept = L.drop_lines(df)
    assert kept.columns == df.columns and kept.count() == len(rows) and kept.where("text is null").count() == 1
    assert L.line_digests(df.limit(0)).count() == 0


def test_stream_decides_a_key_over_many_tasks():
    import pyarrow as pa

    rows = [(b"k", d, 0, [0]) for d in range(30, 0, -1)] + [(b"m", 5, 0, [0])]
    kinds = Counter()
    for part in (rows[:2], rows[2:9], rows[9:25], rows[25:]):
        cols = list(zip(*part, strict=True))
        batch = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int32()))], ["key", "doc_id", "digest", "places"])
        for b in L._stream(5)(iter([batch])):
            kinds.update(b.column("kind").to_pylist())
    assert kinds[L.DROP] == 0 and kinds[L.OPEN] == 30 and kinds[L.EDGE] == 5


def brute_repeats(rows, w=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[p : p + w] for _, b in data for p in range(len(b) - w + 1))
    out = []
    for d, b in data:
        hit = bytearray(len(b))
        for p in range(len(b) - w + 1):
            if seen[b[p : p + w]] > 1:
                hit[p : p + w] = b"\1" * w
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out.append((d, len(b), len(b) - len(kept), sum(1 for k in range(len(b)) if hit[k] and (k == 0 or not hit[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def suffix_rows():
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    p, q = text(210), text(400)
    rows = [(0, "a" * 900), (1, text(300) + p + text(100)), (2, p + text(50)), (3, q), (4, q[50:] + text(20)), (5, text(30) + q[:230]), (6, None), (7, ""), (8, text(199)), (9, q[:100] + "X" + q[101:]), (None, p), (10, "ab" * 300 + text(200)), (11, "ab" * 150)]
    return rows + [(20 + k, text(r.randint(0, 150)) + q[r.randint(0, 90) : r.randint(250, 400)] + text(r.randint(0, 200))) for k in range(30)] + [(90, "dup row " * 40)] * 2


def test_repeats_agree_with_brute_force(spark):
    rows = suffix_rows()
    df = spark.createDataFrame([(*x, 1) for x in rows], DOCS + ", spans int")
    assert sorted((tuple(x) for x in X.repeat_digests(df).collect()), key=str) == brute_repeats(rows)
    cut = X.remove_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(rows)
    assert X.repeat_digests(df.limit(0)).count() == 0


def test_hot_groups_are_split(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT", 40)
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    line, long, copy = text(100), text(260), text(500)
    rows = [(i, text(r.randrange(250)) + line + text(r.randrange(250))) for i in range(300)]
    rows += [(300 + i, text(r.randrange(99)) + long[r.randrange(40) :] + text(r.randrange(99))) for i in range(120)]
    rows += [(500 + i, copy) for i in range(200)] + [(None, copy)] * 3 + [(700 + i, copy[: 60 + 5 * i] + "X" + copy[61 + 5 * i :]) for i in range(60)]
    rows += [(800, rows[0][1]), (801, rows[1][1][:-1]), *suffix_rows()]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert sorted((tuple(x) for x in X.repeat_digests(df).collect()), key=str) == brute_repeats(rows)
    runs = X.sorted_runs(X._texts(df), 1 << 20).cache()
    rows_of = lambda low: runs.where(F.col("bucket").between(low << 20, ((low + 1) << 20) - 1)).groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    tasks = runs.select("run").distinct().count()
    # A q-gram's entries are less than HOT for each of the tasks that it is spread over, and a copy is one row of a task.
    assert rows_of(0) < 2 * X.HOT and 0 < rows_of(1) <= 2 * tasks


def test_a_task_that_holds_little_writes_many_runs(spark, monkeypatch):
    rows = suffix_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    runs = lambda: X.sorted_runs(X._texts(df), 4).select("run").distinct().count()
    few = runs()
    monkeypatch.setattr(X, "RUN_BYTES", 3000)
    assert runs() > 2 * few
    assert sorted((tuple(x) for x in X.repeat_digests(df).collect()), key=str) == brute_repeats(rows)


def test_loser_tree_gives_sorted_suffixes_with_their_common_prefixes():
    r = random.Random(9)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) for _ in range(n)) for n in (0, 1, 7, 30, 12)]
    coded = []
    for run in runs:
        before, rows = b"", []
        for s in run:
            n = X.common_prefix(before, s)
            rows.append((n, s[n:], s))
            before = s
        coded.append(X.decoded(rows))
    got = list(X.LoserTree(coded))
    want = sorted(s for run in runs for s in run)
    assert [g[1] for g in got] == want
    assert [g[0] for g in got[1:]] == [X.common_prefix(a, b) for a, b in zip(want, want[1:])]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if s and 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def jaccard_rows():
    r = random.Random(5)
    doc = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows = []
    for base in [doc(n) for n in (1, 3, 4, 5, 7, 8, 12, 20, 40, 80, 200)]:
        for _ in range(8):
            x = list(base)
            for _ in range(r.choice([0, 1, 1, 2, len(base) // 25 + 1])):
                x[r.randrange(len(x))] = f"z{r.randrange(99)}"
            rows.append(" ".join(x[: len(x) - r.randrange(len(x) // 4 + 1)] if r.random() < 0.3 and len(x) > 4 else x))
    passage, family = " ".join(doc(60)), doc(150)
    rows += [" ".join(doc(r.randrange(5, 80)) + [passage] + doc(r.randrange(5, 100))) for _ in range(60)]
    for _ in range(80):
        x = list(family)
        for _ in range(r.randrange(0, 5)):
            x[r.randrange(150)] = f"y{r.randrange(999)}"
        rows.append(" ".join(x))
    rows = [(i * 3, t) for i, t in enumerate([*rows, "", None, " \n\t", "A b C d E f", "a B c D e F"])]
    r.shuffle(rows)
    return rows


def test_components_agree_with_brute_force(spark):
    rows = jaccard_rows()
    df = spark.createDataFrame([(*x, "clash") for x in rows], DOCS + ", root string")
    want = brute_components(rows)
    assert sorted(tuple(x) for x in J.near_duplicates(df).collect()) == want
    kept = J.keep_representatives(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(d for d, _, c in want if d == c)
    assert J.near_duplicates(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(40))
    got = J.near_duplicates(spark.createDataFrame([(None, t), (4, t), (4, t), (9, t + " end"), (5, None)], DOCS)).collect()
    assert sorted((x.doc_id or -1, x.component_id) for x in got) == [(-1, 4), (4, 4), (4, 4), (5, 5), (9, 4)]


def test_representatives_of_repeated_and_null_ids(spark):
    t, o = " ".join(f"w{i}" for i in range(40)), " ".join(f"o{i}" for i in range(40))
    rows = [(3, t), (5, o), (5, t + " end"), (None, t + " fin"), (7, None), (None, ""), (8, o), (8, o)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOCS + ", hash int, first int")
    kept = J.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, t), (5, o), (7, None), (None, "")], key=str)
    nulls = spark.createDataFrame([(None, t), (None, t + " end"), (1, o), (1, o)], DOCS)
    assert sorted(str(r.doc_id) for r in J.keep_representatives(nulls).collect()) == ["1", "1", "None"]


def test_sets_with_too_few_segments_take_another_seed(monkeypatch):
    import numpy as np
    import pyarrow as pa

    a, b = np.array([7, 7 + 1024, 7 + 2048], np.uint64), np.array([7, 7 + 1024, 7 + 2048, 9], np.uint64)
    held = {"a": a, "b": b}
    assert J.difference(3) == 1 and len(np.unique(a % np.uint64(J.segments(J.band_of(3))))) == 1
    assert J.placed(a)[0] == 1 and J.placed(b)[0] == 0
    monkeypatch.setattr(J, "shingles", held.__getitem__)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b"])], ["text"])
    groups = []
    for seed in (0, 1):
        rows = list(J._packed(1, seed, None if seed == 0 else {J.band_of(3)})(iter([batch])))
        groups.append([m for p in rows for g in J._bucket_groups(p.column("payload").to_pylist()) for m in g.column("members").to_pylist()])
    small = {"id": J.name(a), "size": 3, "own": True}
    assert not any(small in g for g in groups[0]) and any(small in g and len(g) == 2 for g in groups[1])


def test_differences_from_a_hub_meet_in_their_first_shingles():
    import numpy as np

    r, seen = random.Random(4), Counter()
    for _ in range(4000):
        n = r.randrange(20, 60)
        h = np.arange(n, dtype=np.uint64)
        edits = r.randrange(0, n // 2)
        spot = [(r.randrange(n), 1000 + r.randrange(9000)) for _ in range(edits)]

        def member(h=h, spot=spot):
            keep = {int(x) for x in h}
            for at, new in spot + [(r.randrange(n), 20_000 + r.randrange(9)) for _ in range(r.randrange(4))]:
                if r.random() < 0.9:
                    keep.discard(at)
                    keep |= {new} if r.random() < 0.8 else set()
            return np.array(sorted(keep), np.uint64)

        a, b = member(), member()
        if not len(a) or not len(b) or not J.similar(a, b):
            continue
        (la, da, na, ta), (lb, db, nb, tb) = J.first_differences(h, a), J.first_differences(h, b)
        assert la == J.similar(h, a) and lb == J.similar(h, b)
        if la and lb:
            continue
        seen[la + lb] += 1
        t = -(-(7 * (da + db) - len(a) - len(b)) // 14)
        assert t >= 1 and set(ta[: da - t + 1].tolist()) & set(tb[: db - t + 1].tolist())
        assert da - t + 1 <= len(ta) and db - t + 1 <= len(tb) and (la or lb or (da - t + 1 <= na and db - t + 1 <= nb))
    assert min(seen[0], seen[1]) > 50


def test_meeting_pairs_miss_no_link_and_split_parts_agree():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(12)
    h = np.arange(80, dtype=np.uint64)
    family = []
    for k in range(150):
        x = set(family[int(r.integers(k))].tolist()) if k > 40 else set(range(80))
        for at in r.integers(0, 80, r.integers(4, 24) if k <= 40 else 3).tolist():
            x.discard(at)
            x.add(1000 + 5 * at + int(r.integers(0, 2)))
        family.append(np.array(sorted(x), np.uint64))
    made = [J.first_differences(h, x) for x in family]
    links = {(i, j) for j in range(150) for i in range(j) if not (made[i][0] and made[j][0]) and J.similar(family[i], family[j])}
    cols = dict(root=np.where([m[0] for m in made], -1, np.arange(150)), size=np.array([len(x) for x in family]), asks=np.ones(150, bool), linked=np.array([m[0] for m in made]), d=np.array([m[1] for m in made]), near=np.array([m[2] for m in made]), listed=np.array([len(m[3]) for m in made]))
    met = set(map(tuple, J.meeting_pairs(cols, [m[3].view(np.int64) for m in made], [np.arange(len(m[3])) for m in made]).tolist()))
    assert len(links) > 20 and links <= met
    rows = [dict(hub=1, parts=7, set=i, root=int(cols["root"][i]), size=int(cols["size"][i]), asks=True, linked=bool(made[i][0]), d=made[i][1], near=made[i][2], listed=len(made[i][3]), tokens=made[i][3].view(np.int64).tolist()) for i in range(150)]
    parted = pa.Table.from_batches(J._parted(iter(pa.Table.from_pylist(rows).to_batches()))).sort_by([("hub", "ascending"), ("part", "ascending")])
    got = {tuple(sorted((x["set_a"], x["set_b"]))) for b in J._meet(iter(parted.to_batches(max_chunksize=40))) for x in b.to_pylist()}
    assert links <= met <= got  # lists in parts are not whole, so fewer pairs can be ruled out


def test_bands_cover_all_sizes_that_can_be_similar():
    for r in range(1, 3000):
        for s in (r, r * 4 // 3):
            assert J.band_of(s) - J.band_of(r) in (0, 1)
            assert (r + s) // 7 <= J.difference(r)
        assert J.segments(J.band_of(r)) > J.difference(r) or r < J.SHORT


def far_family(n: int) -> list[tuple[int, str]]:
    """Documents that share 79 words; two fifths share 10 more; none is similar to another but every 40th to the one before it."""
    rows: list[tuple[int, str]] = []
    for i in range(n):
        more = [f"s{k}" for k in range(10)] if i % 5 < 2 else []
        own = rows[-1][1].split()[89 if (i - 1) % 5 < 2 else 79 :] if i % 40 == 39 else [f"u{i}x{k}" for k in range(25 - len(more))]
        rows.append((i, " ".join([*(f"c{k}" for k in range(79)), *more, *own])))
    return rows


def test_a_large_family_far_from_its_hub(spark):
    rows = far_family(700)
    want = brute_components(rows)
    assert 0 < sum(d != c for d, _, c in want) < 30
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(x) for x in J.near_duplicates(df).collect()) == want


def test_what_a_family_shares_beside_its_hub_meets_nobody():
    import numpy as np

    sets = [J.shingles(t) for i, t in far_family(3000) if i % 40 != 39]
    made = [J.differences(sets[3], x) for x in sets[4:]]
    tokens, counts = np.unique(np.concatenate([m[4] for m in made]).view(np.int64), return_counts=True)
    table = tokens[counts > J.GROUP][np.argsort(counts[counts > J.GROUP], kind="stable")]
    ordered = J.rank_order(table)
    lists = [ordered(m[4].view(np.int64))[: m[3]] for m in made]
    n = len(made)
    cols = dict(root=np.arange(n), size=np.array([len(x) for x in sets[4:]]), asks=np.ones(n, bool), linked=np.array([m[0] for m in made]), d=np.array([m[1] for m in made]), near=np.array([m[2] for m in made]), listed=np.array([len(x) for x in lists]))
    assert len(table) > 10 and not len(J.meeting_pairs(cols, lists, [np.arange(len(x)) for x in lists]))


def test_tables_hold_frequent_shingles_rarest_first(spark):
    import numpy as np
    import pyarrow as pa

    assert J.rank_order(np.array([5, -2, 9]))(np.array([9, 7, 5, -2, 1])).tolist() == [1, 7, 5, -2, 9]
    rows = [(1, 0, 2, [4, -6], [3, 2]), (1, 0, 2, [8, 4], [9, 1]), (1, 1, 2, [3], [4]), (2, 0, 5, [3, 5], [4, 5])]
    table = pa.Table.from_pylist([dict(zip(J._COUNTED.names, r, strict=True)) for r in rows], schema=J._COUNTED)
    got = [tuple(x.values()) for b in J._summed(iter(table.to_batches(max_chunksize=2))) for x in b.to_pylist()]
    assert got == [(1, 0, 2, [4, 8], [4, 9]), (1, 1, 2, [3], [4]), (2, 0, 5, [5], [5])]
    members = [(i, t) for i, t in far_family(800) if i % 40 != 39]
    texts = J.map_batches(spark.createDataFrame(members, DOCS).withColumn("digest", F.lit(0).cast("long")), J._described, J._MEMBERS).select("set", "packed", "doc_id").cache()
    hub = J.name(J.shingles(members[3][1]))
    pairs = texts.where(F.col("set") != hub).select(F.lit(hub).alias("a"), F.col("set").alias("b"), F.lit(True).alias("asks"))
    (row,) = J._tables(pairs, texts.drop("doc_id")).collect()
    own = set(J.shingles(members[3][1]).view(np.int64).tolist())
    two_fifths, hubs = [x not in own for x in row.table], [x in own for x in row.table]
    assert row.hub == hub and 5 <= sum(two_fifths) <= 15 and sum(hubs) >= 20 and sorted(hubs) == hubs  # what all lack comes last
    differ = J._dealt(pairs, texts.drop("doc_id"), J._tables(pairs, texts.drop("doc_id"))).mapInArrow(J._differ, J._DIFFER_DDL).collect()
    assert len(differ) == len(members) - 1
    for r in differ:
        rank = [row.table.index(x) + 1 if x in row.table else 0 for x in r.tokens]
        assert rank == sorted(rank)


def test_shared_counts_agree_with_sets():
    import numpy as np

    r = np.random.default_rng(3)
    lists = [np.unique(r.integers(0, 40, r.integers(0, 30))) for _ in range(60)]
    pairs = r.integers(0, 60, (500, 2))
    assert J._shared(lists, pairs).tolist() == [len(set(lists[i].tolist()) & set(lists[j].tolist())) for i, j in pairs.tolist()]
