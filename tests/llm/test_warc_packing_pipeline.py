"""Archives, packing and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline as P
from creditlake.llm import op09_warc as W
from creditlake.llm import op10_packing as K
from creditlake.llm import registry
from creditlake.llm.op02_bpe import tokenizer_path
from tests.oracle import agrees


def test_archives_agree_with_sql(spark, sf):
    agrees(W.op9_warc(spark, sf), W.SQL, sf)


def test_archives_with_odd_rows(spark):
    big, rows = "<p>é</p>" * 200, []
    rows = [(1, "u", big), (2, "u\r\nX: y", big), (2, "u", big), (3, None, None), (4, "u", ""), (None, "n", big), (5, "v", "small"), (6, "v", "small"), (7, "w", big + "\r\n\r\nx")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in W.read_archives(spark, W.write_archives(df)).collect() if r.page_id is not None)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    n = len(big.encode())
    assert got == sorted([(1, n, sha(big), "revisit", 2), (2, n, sha(big), "response", None), (2, n, sha(big), "response", None), (3, 0, sha(""), "response", None), (4, 0, sha(""), "response", None), (5, 5, sha("small"), "response", None), (6, 5, sha("small"), "response", None), (7, n + 5, sha(big + "\r\n\r\nx"), "response", None)])
    full = {r.page_id: r for r in W.read_archives(spark, W.write_archives(df), payload=True).collect()}
    assert full[None].record_type == "revisit" and full[None].refers_to == 2 and full[7].payload.decode() == big + "\r\n\r\nx"
    assert W.read_archives(spark, W.write_archives(df.limit(0))).count() == 0


def test_broken_archives_raise():
    rows = [(i, "u", b"payload %d" % i * 50, hashlib.sha1(b"payload %d" % i * 50).hexdigest(), None) for i in range(30)]
    (whole, n), = W.archive(rows, b"")
    assert n == 30 and [W.parse(r)[0] for r in W.records(whole)] == list(range(30))
    for bad in (whole[:-3], whole[8:], b"\0" * 20):
        with pytest.raises((W.ArchiveError, zstandard.ZstdError)):
            list(W.records(bad))
    good = W.record(*rows[0])
    for was, now in ((b"payload 0p", b"payload 1p"), (b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 4", b"Content-Length: 5"), (b"WARC-Type: response", b"WARC-Type: revisit")):
        with pytest.raises(W.ArchiveError):
            W.parse(good.replace(was, now, 1))


def test_dictionary_of_pages_is_used():
    page = lambda i: ("<html><head><title>page</title></head><body class='x'>" + "<nav>menu of links that every page repeats, word for word</nav>" * 3 + str(hash(i)) + "".join(f"<li>{i * k % 97}</li>" for k in range(6))).encode()
    dictionary = zstandard.train_dictionary(4096, [page(i) for i in range(200)]).as_bytes()
    rows = [(i, "u", page(i), hashlib.sha1(page(i)).hexdigest(), None) for i in range(300, 340)]
    ((small, _),), ((large, _),) = W.archive(rows, dictionary), W.archive(rows, b"")
    assert len(small) - len(dictionary) < len(large)
    assert [W.parse(r)[5] for r in W.records(small)] == [page(i) for i in range(300, 340)]


TEXTS = ["", "a  b\n\nc ", "don't 'tis  x", "\tlead", "<|endoftext|> x<|endoftext|>", "日本語 ½ 10²", "\xa0 x y", "a\x1cb", "x" * 5000, " \n \n", "é😀 end  "]


def test_ids_are_those_of_tokenizers(sf):
    import pyarrow.parquet as pq
    import tokenizers

    tk, e = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), K.encoder(tokenizer_path("byte_bpe_50k.tiktoken"))
    r = random.Random(2)
    odd = ["".join(r.choice("ab1 \n\t'é.,s t\xa0") for _ in range(40)) for _ in range(400)]
    for t in TEXTS + odd + [x or "" for x in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()]:
        assert np.frombuffer(e.ids(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, t[:80]


def test_hilbert_is_a_path_through_every_cell():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n), -1).reshape(-1, n)
        key = K.hilbert(cells, bits)
        path = cells[np.argsort(key)]
        assert sorted(key) == list(range(len(cells))) and (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_packing_holds_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"text {i} " * (i % 40)) for i in range(150)] + [(None, None), (3, "\tlead")]
    e = K.encoder(tokenizer_path("byte_bpe_50k.tiktoken"))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, offset string")
    pieces = K.pack(df, tokenizer_path("byte_bpe_50k.tiktoken"), 256).collect()
    want = sorted((d, e.ids(t or "") + b"\1\0\0\0") for d, t in rows if d is not None and d != 3)
    by = {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(p.ids) and len(p.ids) == 4 * p.length and p.length > 0
        by.setdefault(p.doc_id, []).append(p)
    assert [(d, b"".join(x.ids for x in sorted(by[d], key=lambda x: x.start))) for d in sorted(k for k in by if k is not None and k != 3)] == want
    assert len(by[None]) == 1 and sum(p.length for p in by[3]) == 2 * by[3][0].doc_tokens
    full = {}
    for p in pieces:
        full.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in full.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256 and at & (at - 1) == 0
    assert K.pack(df.limit(0), tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_neighbours_on_the_curve_are_alike(spark):
    rows = [(i, ("alpha beta gamma " if i % 2 else "über straße größe ") * 30 + str(i)) for i in range(60)]
    order = [r.doc_id % 2 for r in K.along_curve(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).coalesce(1).collect()]
    assert sum(a != b for a, b in zip(order, order[1:])) <= 3


def documents(spark):
    r = random.Random(6)
    text = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    line, passage = "A licence line that every document of this corpus repeats", text(80)
    rows = [(i, text(60) + "\n" + line + "\n" + text(40)) for i in range(30)]
    rows += [(40, text(150)), (41, text(120) + " " + passage + " " + text(120)), (42, passage + " " + text(130)), (43, None), (44, ""), (45, "tiny")]
    rows += [(50, rows[30][1] + " end"), (51, "idiot scum moron " * 3 + text(30)), (None, text(20))]
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), line, passage


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs, line, passage = documents(spark)
    learn, labels = [], []
    r = random.Random(7)
    for i in range(1000, 1600):
        bad = i % 5 == 0
        learn.append((i, " ".join(f"w{r.randrange(300)}" for _ in range(30)) + (" idiot scum moron" if bad else ""), "en", "s", 0))
        labels.append((i, 0, int(bad)))
    docs = docs.unionByName(spark.createDataFrame(learn, docs.schema))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out-{name}")
        docs = spark.read.parquet(f"{tmp_path}/out-{name}")
        kept[name] = docs.where("doc_id < 1000 or doc_id is null").collect()
    ids = {k: {x.doc_id for x in v} for k, v in kept.items()}
    start = {*range(30), 40, 41, 42, 43, 44, 45, 50, None}
    assert ids["toxicity"] == start
    assert sum(line in (x.text or "") for x in kept["line_dedup"]) == 1 and ids["line_dedup"] == start
    assert ids["near_duplicates"] == start - {50}
    assert not any(passage[50:-50] in (x.text or "") for x in kept["suffix_dedup"]) and ids["suffix_dedup"] == start - {50}
    assert all(x.n_chars == len(x.text) for x in kept["suffix_dedup"] if x.text is not None)
    assert ids["packing"] == start - {50}
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "suffix_dedup", "packing"]


def test_pipeline_over_empty_and_odd_tables(spark, tmp_path):
    docs, _, _ = documents(spark)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = spark.createDataFrame([(None, None, 1), (3, "", 2), (3, "", 2), (4, "a\nb", None)], "doc_id long, text string, row int")
    for start in (docs.limit(0), odd.withColumnsRenamed({"row": "digest"}), odd.withColumn("packed", F.lit("clash"))):
        now = start
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == start.columns
        assert now.count() == start.count()
        assert P.STAGES[-1][1](spark, now, str(tmp_path)).count() == start.count()


def test_large_archives_roll_over(monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(W, "ARCHIVE_BYTES", 9_000)
    pages = [(i, f"u{i}", (t := "".join(r.choice("abcdef<>") for _ in range(2500)).encode()), hashlib.sha1(t).hexdigest(), None) for i in range(60)]
    made = list(W.archive(pages, b""))
    assert len(made) > 3 and sum(n for _, n in made) == 60 and made == list(W.archive(pages, b""))
    assert [W.parse(x)[0] for data, _ in made for x in W.records(data)] == list(range(60))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_give_one_schema(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
