"""Periodic runs of words: stretches that repeat themselves, found in each document and cut down to their first period.

A run is a stretch of consecutive words with smallest period q, at least MIN_WORDS long and MIN_TIMES periods, that no neighbouring
word extends keeping the period. Words are runs without [\\x20\\x09-\\x0D].

``grid``: words q apart that are identical form a match interval, of at least (MIN_TIMES - 1) * q places for a run. So one of the
places 0, 2q, 4q, ... lies less than 2q behind the interval's start and matches on for more than (MIN_TIMES - 3) * q words. All
such places of all periods are n * ln(n) / 2 pairs (the harmonic sum), held against each other as arrays.

``Lce`` tells how far the words from two places on are the same. Of every COVER places those of a difference cover are sampled,
so that for any two places some shift of less than COVER words brings both to samples. Only the sampled suffixes are sorted, by the
rank of their first COVER words and then by prefix doubling over those ranks, with their common prefixes in a sparse table. A
question compares fewer than COVER words, and if they are the same it is one range minimum. A document in which no pair agrees for
a few words never builds the index; the index of the reversed words, for the way back, is built only if the way forth was long enough.

No row leaves its task: documents are independent, so nothing is exchanged, and a lost task is repeated by itself. A task holds one
document at a time: some 60 bytes a word, and PAIRS pairs.

Defined cases: null and empty texts have no words and no runs; rows that repeat a doc_id are documents of their own; a null doc_id
stays null; an empty table gives no rows; other columns pass through ``collapse_runs`` and are ignored by ``periodic_runs``. A text
without a run is left as it is by ``collapse_runs``, one with a run becomes its kept words with single blanks between them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm.common import map_batches, only, read, small_batches, text_of

MIN_WORDS, MIN_TIMES = 6, 4
#: A perfect difference cover: every difference modulo 13 is one of two of these places.
COVER, SAMPLES = 13, (0, 1, 3, 9)
#: Pairs of places that are held against each other at once.
PAIRS = 1 << 20
#: Grids of texts of so many words are made once.
USUAL = 8192


def _shifts() -> np.ndarray:
    """For two places modulo COVER, the least shift that brings both to samples."""
    out = np.zeros((COVER, COVER), np.int64)
    for a in range(COVER):
        for b in range(COVER):
            out[a, b] = next(h for h in range(COVER) if (a + h) % COVER in SAMPLES and (b + h) % COVER in SAMPLES)
    return out


_SHIFT = _shifts()


class Lce:
    """Longest common extensions of places i < j: how many words from them on are the same. words: numbers from 1."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.append(words, np.zeros(2 * COVER, np.int64)).astype(np.int64)  # 0 ends the text; no word is 0
        self.table: list[np.ndarray] | None = None

    def _build(self) -> None:
        classes = [np.arange(d, self.n + 1, COVER) for d in SAMPLES]  # up to n, so each class ends in a block that no other equals
        self.base = np.full(COVER, -1, np.int64)
        self.base[list(SAMPLES)] = np.cumsum([0, *map(len, classes[:-1])])
        at = np.concatenate(classes)
        bits = max(1, int(self.words.max()).bit_length())
        keys = []
        for start in range(0, COVER, each := 63 // bits):  # as many words as one number holds
            key = np.zeros(len(at), np.int64)
            for k in range(start, min(start + each, COVER)):
                key = (key << bits) | self.words[at + k]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for key in keys:
            new[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new)
        levels, step = [], 1  # levels[k] ranks samples by their first 2^k blocks
        while True:
            levels.append(rank.astype(np.int32))
            if rank[order[-1]] == len(at) - 1:
                break
            nxt = np.zeros(len(at), np.int64)
            nxt[:-step] = rank[step:] + 1
            key = rank * (len(at) + 1) + nxt
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(at), np.int64)
            rank[order] = np.cumsum(np.append(False, key[order[1:]] != key[order[:-1]]))
            step *= 2
        self.rank = levels[-1]
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(len(at) - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < len(at)) & (b < len(at)))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            for x, add in ((a, 1 << k), (b, 1 << k), (common, COVER << k)):
                x[same] += add
        common += self._few(at[order[:-1]] + common, at[order[1:]] + common, np.full(len(common), COVER))
        self.table, span = [common.astype(np.int32)], 1
        while 2 * span <= len(common):
            self.table.append(np.minimum(self.table[-1][:-span], self.table[-1][span:]))
            span *= 2

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that are the same from i and j on, up to ``most`` of each pair."""
        out, on = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(COVER):
            on = on[most[on] > t]
            on = on[self.words[i[on] + t] == self.words[j[on] + t]]
            if not len(on):
                break
            out[on] = t + 1
        return out

    def _sampled(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The same for two samples: the least common prefix of neighbours between them in order."""
        if self.table is None:
            self._build()
        a, b = (self.rank[self.base[x % COVER] + x // COVER].astype(np.int64) for x in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            out[at] = np.minimum(self.table[level][low[at]], self.table[level][high[at] - (1 << level)])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        shift = _SHIFT[i % COVER, j % COVER]
        out = self._few(i, j, shift)
        far = np.flatnonzero(out == shift)
        if len(far):
            out[far] += self._sampled(i[far] + shift[far], j[far] + shift[far])
        return out


def _pairs(n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods of the grid of n words for periods from first to last."""
    q = np.arange(first, last + 1)
    counts = np.maximum(0, (n - 2 * q) // (2 * q) + 1)
    period = np.repeat(q, counts)
    place = (np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)) * 2 * period
    return place, period


@lru_cache(maxsize=1)
def _usual() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grid of USUAL words by the number of words that a pair needs, so a shorter text takes the start of it."""
    place, period = _pairs(USUAL, 1, USUAL // 2)
    needs = place + 2 * period
    order = np.argsort(needs, kind="stable")
    return place[order], period[order], needs[order]


def grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place, period) whose words may match on for more than a period, in parts of about PAIRS."""
    if n <= USUAL:
        place, period, needs = _usual()
        last = np.searchsorted(needs, n, "right")
        yield place[:last], period[:last]
        return
    first = 1
    while first <= n // 2:
        last = max(first, min(n // 2, first + first * PAIRS * 2 // n))
        yield _pairs(n, first, last)
        first = last + 1


def runs(words: list[bytes], min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period. min_times: at least 4."""
    n, none = len(words), np.empty((0, 3), np.int64)
    if n < max(min_words, min_times):
        return none
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen) + 1) for w in words), np.int64, n)
    if len(seen) == n:
        return none
    forth, back, found = Lce(ids), None, []
    for place, period in grid(n):
        for t in range(2):  # a match interval goes on for two places at least
            on = np.flatnonzero(forth.words[place + t] == forth.words[place + period + t])
            place, period = place[on], period[on]
        if not len(place):
            continue
        ahead = forth(place, place + period)
        on = np.flatnonzero(ahead > period)
        place, period, ahead = place[on], period[on], ahead[on]
        if not len(place):
            continue
        back = back or Lce(ids[::-1])
        before = back(n - place - period, n - place)
        start, length = place - before, before + ahead + period
        on = length >= np.maximum(min_words, min_times * period)
        found.append(np.unique(np.column_stack([start, length, period])[on], axis=0))
    if not found:
        return none
    rows = np.unique(np.concatenate(found), axis=0)
    same = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)  # a multiple of the smallest period gives the same stretch
    rows = rows[np.append(True, ~same)] if len(rows) else rows
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def kept(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """Words that no run holds behind its first period."""
    if not len(found):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def split(doc_id: int | None, text: str) -> list[bytes]:
    return text.encode().split()  # at [\x20\x09-\x0D], as bytes are split


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(documents: DataFrame, words_of: Callable[[int | None, str], list[bytes]] = split, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """doc_id, runs (array of start, length, period; by start, then period), collapsed (the kept words, a blank between two)."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = words_of(doc, text)
                rows = runs(words, min_words, min_times)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in rows.tolist()])
                texts.append(b" ".join(kept(words, rows)).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, _RUNS), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    texts = only(documents, doc_id=documents["doc_id"].cast("long"), text=text_of(documents))
    return map_batches(texts, run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def collapse_runs(documents: DataFrame, min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> DataFrame:
    """documents, all columns, with runs cut down to their first period."""

    @F.pandas_udf("string")
    def collapsed(texts):
        def one(text: str) -> str:
            words = split(None, text)
            rows = runs(words, min_words, min_times)
            return b" ".join(kept(words, rows)).decode() if len(rows) else text

        return texts.map(one, na_action="ignore")

    small_batches(documents.sparkSession)
    return documents.withColumn("text", collapsed(documents["text"].cast("string")))


def planted(doc_id: int | None, text: str) -> list[bytes]:
    """Words of a text, with a period planted into every tenth document by the hash of its id; none where the id is null."""
    words = split(doc_id, text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def run_digests(documents: DataFrame, words_of: Callable[[int | None, str], list[bytes]] = split) -> DataFrame:
    """Each document's number of runs, its longest run, and digests of all runs and of the kept words."""
    longest = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS start, -r.period AS period)))")
    lines = F.expr("concat(array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period)), '\n'), if(size(runs) > 0, '\n', ''))")
    found = periodic_runs(documents, words_of).select("doc_id", "runs", longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    period, length = -F.col("top.period"), F.col("top.length")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read(spark, sf_dir, "documents"), planted)


#: CRC-32 of a column's decimal text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length({0}::VARCHAR)), lambda i: ascii(({0}::VARCHAR)[i + 1])::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)))"""
SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC32.format("doc_id")} AS h FROM documents),
cut AS (
  SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS loops, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) ELSE 0 END AS a, 3 + (h // 10) % 8 AS parts FROM d),
word AS (
  SELECT doc_id, n, i, w[CASE WHEN loops AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END + 1] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM cut)),
same AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
top AS (
  SELECT doc_id, count(*) AS n_runs, arg_max(struct_pack(s := start, l := length, p := period), (length, -start, -period)) AS t, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, t.s AS start, t.l AS length, t.p AS period, 1000 * t.l // t.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(left_over.text, '')) AS collapsed_sha256
FROM d LEFT JOIN top USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
