"""Suffix-array dedup: bytes covered by a string of 200 bytes that starts anywhere else are removed.

1. ``repeated_anchors``: every window of 200 bytes owns an anchor (see ``windows``); a window can only repeat if the q-gram at its
   anchor does. Anchor hashes are dealt in order (``Ranges``) and sorted, and runs of one are left out (see ``marks``). Places whose
   q-gram has HOT rows or more are marked.
2. ``sorted_runs``: each task sorts the suffixes at the remaining anchors of its documents, with the bytes before them as far as
   their windows reach. Equal ones become one entry; if it has several owners, all their windows repeat, so their spans are known
   at once and the entry goes on without owners. The sorted run is front-coded (common prefix with the entry before, and the
   rest) and exchanged by q-gram, so the runs of many tasks meet in buckets. A task writes a run whenever it holds RUN_BYTES. The
   entries of marked places are not exchanged by q-gram, but each of their windows by its own 128-bit hash, so they are spread evenly
   and only equal windows meet; these are judged by that hash and not by their bytes.
3. ``merged``: a bucket's runs are combined by a loser tree that keeps, for each run, the length of the prefix its head has in
   common with the last entry that came out, and compares from there on only. It yields the suffixes in order with their common
   prefixes, so the suffixes of one q-gram are neighbours.
4. ``repeats``: among neighbours that share the q-gram, a window at offset o before the anchor repeats if another entry has the
   same o bytes before it and a common prefix of at least 200 - o. Common prefixes come from the merge and are not compared again.
   ``met`` does it for the windows that came by their hash.

What comes back to the documents is spans. Nothing else of a text is exchanged but what stands around repeated q-grams, and the
texts, compressed, to meet their anchors and then their spans.

Memory: a task of step 2 holds RUN_BYTES and one document, step 3 one bucket; of a q-gram that isn't marked it holds less than HOT
surroundings (400 bytes at most each). Copies add one row for each run of step 2 that has them, not one for each copy.

Defined cases: null or short text loses nothing; rows that repeat a doc_id and text are two places, so both lose what they share;
a null doc_id is returned as null; an empty table gives no rows; other columns pass through ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm.common import Ranges, ints, map_batches, only, packed, partitions, read, sampled, small_batches, text_of, unpacked
from creditlake.llm.marks import repeated_places
from creditlake.llm.windows import GRAM, WINDOW, anchors, mix

#: Buckets a partition of the exchange holds; each is merged by itself, which bounds what a task holds.
BUCKETS = 16
#: Groups of so many entries are compared pair by pair, larger ones offset by offset.
FEW = 8
#: A q-gram with so many rows is decided window by window.
HOT = 1000
#: Windows of such q-grams that a task holds before it hands them on.
HELD = 200_000
#: Bytes of suffixes, with what Python needs beside them, that a task holds before it writes a run.
RUN_BYTES, BESIDE = 128 << 20, 400


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that the first ``known`` bytes agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, high = known, n - 1  # a and b agree before low; they differ somewhere in [low, high]
    while low < high:
        mid = (low + high) // 2
        if a[low : mid + 1] == b[low : mid + 1]:
            low = mid + 1
        else:
            high = mid
    return low


class LoserTree:
    """Merges sorted runs of (suffix, item) without comparing known prefixes again.

    Each run's head carries the length of its common prefix with the last suffix that won. Of two heads the one with the longer
    such prefix is smaller; only if they are equal are bytes compared, from that length on, and the loser's length becomes its
    common prefix with the winner.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.size = 1 << max(0, len(runs) - 1).bit_length()
        self.heads: list[tuple[bytes, object] | None] = [None] * self.size
        self.known = [0] * self.size
        for i in range(len(runs)):
            self.advance(i, 0)
        self.losers = [0] * self.size
        self.winner = self.build(1)

    def advance(self, i: int, known: int | None = None) -> None:
        """The next head of run i; its common prefix with the one before is the run's own front coding."""
        nxt = next(self.runs[i], None) if i < len(self.runs) else None
        if nxt is None:
            self.heads[i] = None
        else:
            self.heads[i] = nxt[1], nxt[2]
            self.known[i] = nxt[0] if known is None else known

    def build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self.build(2 * node), self.build(2 * node + 1)
        winner = self.play(a, b)
        self.losers[node] = b if winner == a else a
        return winner

    def play(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return b if x is None else a
        if self.known[a] != self.known[b]:
            return a if self.known[a] > self.known[b] else b
        n = common_prefix(x[0], y[0], self.known[a])
        first = x[0][n : n + 1] < y[0][n : n + 1] or (x[0][n : n + 1] == y[0][n : n + 1] and a < b)
        self.known[b if first else a] = n
        return a if first else b

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(common prefix with the suffix before, suffix, item) in order."""
        while (head := self.heads[self.winner]) is not None:
            i = self.winner
            yield self.known[i], *head
            self.advance(i)
            node = (i + self.size) // 2
            winner = i
            while node:
                other = self.losers[node]
                if self.play(winner, other) != winner:
                    self.losers[node], winner = winner, other
                node //= 2
            self.winner = winner


def decoded(rows: list[tuple]) -> Iterator[tuple[int, bytes, object]]:
    """A front-coded run as (common prefix with the entry before, suffix, rest of the row)."""
    before = b""
    for common, tail, *rest in rows:
        before = before[:common] + tail
        yield common, before, rest


def _few(suffixes: list[tuple[int, bytes, tuple]], out: list, window: int) -> list[np.ndarray | None]:
    """repeats() pair by pair: two entries agree in the windows at offsets from window - (common suffix) to (common bytes before)."""
    for i, (_, _, (left, _, n, _)) in enumerate(suffixes):
        right = window
        for j in range(i + 1, len(suffixes)):
            common, _, (other, _, m, _) = suffixes[j]
            right = min(right, common)
            if out[i] is None and out[j] is None:
                continue
            low = max(window - right, len(left) - n + 1, len(other) - m + 1)
            high = min(common_suffix(left, other), len(left), len(other))
            if low <= high:
                for k, reach in ((i, len(left)), (j, len(other))):
                    if out[k] is not None:
                        out[k][reach - high : reach - low + 1] = True
    return out


def common_suffix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[len(a) - n :] == b[len(b) - n :]:
        return n
    low, high = 0, n - 1  # the last low bytes agree; they differ within the last high + 1
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid - 1
    return low


def repeats(suffixes: list[tuple[int, bytes, tuple]], window: int = WINDOW) -> list[np.ndarray | None]:
    """For each entry (common prefix with the one before, suffix, (before, owners, windows, many)): which of its windows repeat.

    All entries share the q-gram. ``None`` stands for all windows: an entry that occurs more than once. Entries are distinct.
    """
    out: list = [None if e[2][3] else np.zeros(e[2][2], bool) for e in suffixes]
    if len(suffixes) == 1 or all(o is None for o in out):
        return out
    if len(suffixes) <= FEW:
        return _few(suffixes, out, window)
    common = np.array([e[0] for e in suffixes])
    reach = [len(e[2][0]) for e in suffixes]  # offset of the first window; the others follow one by one
    lowest = [r - e[2][2] + 1 for r, e in zip(reach, suffixes, strict=True)]
    lengths = np.array([len(e[1]) for e in suffixes])
    for o in range(min(lowest), max(reach) + 1):
        part = np.cumsum(common < window - o)  # entries of one part agree in the 200 - o bytes from the anchor on
        seen: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(lengths >= window - o):
            if lowest[i] <= o <= reach[i]:
                key = (int(part[i]), suffixes[i][2][0][reach[i] - o :])
                j = seen.setdefault(key, i)
                if j != i:
                    for k in (i, j):
                        if out[k] is not None:
                            out[k][reach[k] - o] = True
    return out


def merged(bucket: list[list[tuple]]) -> Iterator[tuple[object, int, int]]:
    """(owner, start, end) of repeated bytes, from the front-coded runs of one bucket."""
    group: list[tuple[int, bytes, tuple]] = []
    alike: dict[bytes, list] = {}  # entries with the present suffix, by the bytes before it

    def flush() -> Iterator[tuple[object, int, int]]:
        for (_, _, (_, owners, windows, _)), hit in zip(group, repeats(group), strict=True):
            if hit is None:
                for doc, first in owners:
                    yield doc, first, first + windows - 1 + WINDOW
            elif hit.any():
                (doc, first), edges = owners[0], np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    yield doc, first + a, first + b - 1 + WINDOW

    for common, suffix, (before, owners, windows, many) in LoserTree([decoded(r) for r in bucket]):
        if group and common < GRAM:
            yield from flush()
            group = []
        if not (group and common == len(suffix) == len(group[-1][1])):
            alike = {}
        if (same := alike.get(before)) is not None:
            same[1].extend(owners)
            same[3] = True
        else:
            alike[before] = [before, list(owners), windows, many]
            group.append((common, suffix, alike[before]))
    if group:
        yield from flush()


def met(rows: Iterator[tuple[bytes, tuple | None]]) -> Iterator[tuple[object, int, int]]:
    """(owner, start, end) of windows whose key occurs again; no owner stands for several that are known."""
    waits: dict[bytes, tuple | None] = {}
    for key, owner in rows:
        if key not in waits:
            waits[key] = owner
            continue
        for found in (waits[key], owner):
            if found is not None:
                yield found[:2], found[2], found[2] + WINDOW
        waits[key] = None


def _spot(docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Spreads the rows of a frequent q-gram, be they of many documents or of one."""
    return mix(docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64)).view(np.int64)


def _anchor_rows(ranges: Ranges | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, grams, places = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for a in anchors(text.encode()):
                    rows.append(np.full(len(a.at), i, np.int32))
                    grams.append(a.gram.view(np.int64))
                    places.append(a.at)
            if rows:
                at, gram = pa.array(np.concatenate(rows)), np.concatenate(grams)
                doc, place = b.column("doc_id").take(at), np.concatenate(places).astype(np.int64)
                part = np.zeros(len(gram), np.int32) if ranges is None else ranges.part(gram, _spot(ints(doc), place))
                yield pa.RecordBatch.from_arrays([pa.array(gram), doc, b.column("digest").take(at), pa.array(place.astype(np.int32)), pa.array(part)], ["gram", "doc_id", "digest", "place", "part"])

    return run


def repeated_anchors(texts: DataFrame) -> DataFrame:
    """doc_id, digest, places: anchors of each document whose q-gram occurs elsewhere; -1 - place if it is frequent."""
    row, n = "gram long, doc_id long, digest long, place int, part int", partitions(texts)
    known = map_batches(sampled(texts), _anchor_rows(None), row).select("gram", "doc_id", "place").limit(200_000).toArrow()  # bounded; affects the balance only
    ranges = Ranges(known["gram"].to_numpy(), _spot(ints(known["doc_id"].combine_chunks()), known["place"].to_numpy()), n)
    sorted_ = map_batches(texts, _anchor_rows(ranges), row).repartitionById(n, F.col("part")).drop("part").sortWithinPartitions("gram")
    return repeated_places(sorted_, HOT)


#: Buckets are numbered: those of q-grams, then as many of windows (tail is the key), then as many of known spans (windows is the length).
_RUN = pa.schema([("bucket", pa.int32()), ("run", pa.int64()), ("seq", pa.int64()), ("common", pa.int32()), ("tail", pa.binary()), ("before", pa.binary()), ("windows", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("first", pa.int64()), ("many", pa.bool_())])
_RUN_DDL = "bucket int, run long, seq long, common int, tail binary, before binary, windows int, doc_id long, digest long, first long, many boolean"


class _Known:
    """Spans of documents that a task is sure of."""

    def __init__(self) -> None:
        self.spans: dict[tuple, list[tuple[int, int]]] = {}

    def add(self, doc: int | None, digest: int, start: int, end: int) -> None:
        spans = self.spans.setdefault((doc, digest), [])
        if spans and spans[-1][0] <= start <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((start, end))

    def taken(self) -> Iterator[tuple[int | None, int, int, int]]:
        for (doc, digest), spans in self.spans.items():
            for start, end in joined(sorted(spans)):
                yield doc, digest, start, end
        self.spans = {}


def _run_rows(entries: dict[tuple[int, bytes, bytes], list[tuple]], buckets: int) -> Iterator[tuple]:
    """Rows of _RUN, without run and seq, of a task's entries; those of bucket -1 are dealt out window by window."""
    known, held = _Known(), {}

    def handed() -> Iterator[tuple]:
        for key, owner in held.items():
            yield buckets + int.from_bytes(key[:8], "little") % buckets, 0, key, None, 1, *(owner or (None, None, None)), owner is None
        held.clear()
        for doc, digest, start, end in known.taken():
            yield 2 * buckets + hash((doc or 0, digest)) % buckets, 0, None, None, end - start, doc, digest, start, False

    before = -1, b""
    for key in sorted(entries):
        bucket, suffix, left = key
        owners = entries.pop(key)
        doc, digest, first, n = owners[0]
        many = len(owners) > 1
        if many:
            for d, g, f, _ in owners:
                known.add(d, g, f, f + n - 1 + WINDOW)
        if bucket < 0:
            data = left + suffix
            for k in range(n):
                window, mine = xxhash.xxh3_128_digest(data[k : k + WINDOW]), None if many else (doc, digest, first + k)
                if window not in held:
                    held[window] = mine
                    continue
                for found in (held[window], mine):
                    if found is not None:
                        known.add(*found, found[2] + WINDOW)
                held[window] = None
            if len(held) >= HELD:
                yield from handed()
            continue
        common = common_prefix(before[1], suffix) if before[0] == bucket else 0
        yield bucket, common, suffix[common:], left, n, *((None, None, None) if many else (doc, digest, first)), many
        before = bucket, suffix
    yield from handed()


def _runs(buckets: int, most: int):
    """A task's entries as sorted runs, each of about ``most`` bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId() << 32
        entries: dict[tuple[int, bytes, bytes], list[tuple]] = {}
        held = number = 0

        def written() -> Iterator[pa.RecordBatch]:
            rows = ((bucket, me + number, seq, *rest) for seq, (bucket, *rest) in enumerate(_run_rows(entries, buckets)))
            for some in itertools.batched(rows, 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*some, strict=True), _RUN, strict=True)], schema=_RUN)

        for b in batches:
            for doc, digest, packed_, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "packed", "places")), strict=True):
                data, wanted = unpacked(packed_), np.array(places)
                marked = -1 - wanted[wanted < 0]
                wanted = np.append(wanted[wanted >= 0], marked)
                for a in anchors(data):
                    hit = np.flatnonzero(np.isin(a.at, wanted))
                    hot = np.isin(a.at[hit], marked) if len(marked) else np.zeros(len(hit), bool)
                    for at, gram, first, last, often in zip(a.at[hit].tolist(), a.gram[hit].tolist(), a.first[hit].tolist(), a.last[hit].tolist(), hot.tolist(), strict=True):
                        key = -1 if often else gram % buckets, data[at : last + WINDOW], data[first:at]
                        if key not in entries:
                            entries[key] = []
                            held += len(key[1]) + len(key[2]) + BESIDE
                        entries[key].append((doc, digest, first, last - first + 1))
                        held += BESIDE // 4
                    if held >= most:
                        yield from written()
                        entries, held, number = {}, 0, number + 1
        yield from written()

    return run


def _merge(buckets: int):
    def decided(number: int, bucket: Iterator[tuple]) -> Iterator[tuple[tuple, int, int]]:
        if number >= 2 * buckets:
            for _, _, _, _, _, _, length, doc, digest, start, _ in bucket:
                yield (doc, digest), start, start + length
        elif number >= buckets:
            yield from met((key, None if many else (doc, digest, start)) for _, _, _, _, key, _, _, doc, digest, start, many in bucket)
        else:
            runs = []
            for _, run in itertools.groupby(bucket, key=lambda r: r[1]):
                runs.append([(common, tail, before, [] if many else [((doc, digest), first)], windows, many) for _, _, _, common, tail, before, windows, doc, digest, first, many in run])
            yield from merged(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in _RUN.names), strict=True))
        spans: list[tuple] = []
        for number, bucket in itertools.groupby(rows, key=lambda r: r[0]):
            for owner, start, end in decided(number, bucket):
                spans.append((*owner, start, end))
                if len(spans) >= 4096:
                    yield _spans(spans)
                    spans = []
        yield _spans(spans)

    return run


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "digest", "start", "end"])


def _texts(documents: DataFrame) -> DataFrame:
    small_batches(documents.sparkSession)
    text = text_of(documents)
    return only(documents, doc_id=documents["doc_id"].cast("long"), digest=F.xxhash64(text), text=text)


def _packed(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "digest", packed(F.col("text")).alias("packed"))


def _meet(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined by document, null ids included."""
    r = right.withColumnsRenamed({"doc_id": "_doc", "digest": "_digest"}).hint("merge")
    return left.join(r, left["doc_id"].eqNullSafe(r["_doc"]) & (left["digest"] == r["_digest"]), how).drop("_doc", "_digest")


def sorted_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """Rows of _RUN: entries, windows of frequent q-grams and spans that are known already."""
    return map_batches(_meet(_packed(texts), repeated_anchors(texts), "inner"), _runs(buckets, RUN_BYTES), _RUN_DDL)


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc_id, digest, spans (array of start, end in bytes, not yet united) of each document with repeated bytes."""
    texts = _texts(documents)
    n = partitions(texts)
    dealt = sorted_runs(texts, n * BUCKETS).repartition(n, "bucket").sortWithinPartitions("bucket", "run", "seq")
    return dealt.mapInArrow(_merge(n * BUCKETS), "doc_id long, digest long, start long, end long").groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def united(spans: list) -> list[tuple[int, int]]:
    """Disjoint runs, in order; spans that touch become one."""
    return joined(sorted((x["start"], x["end"]) for x in (() if spans is None else spans)))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; those that touch become one."""
    out: list[tuple[int, int]] = []
    for s in spans:
        if out and s[0] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], s[1])
        else:
            out.append(s)
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """documents, all columns, with what is left as text; a character that was cut through is left out."""

    @F.pandas_udf("string")
    def kept(texts, spans):
        return texts.combine(spans, lambda p, s: None if p is None else (unpacked(p) if s is None else without(unpacked(p), united(s))).decode("utf-8", "ignore"))

    small_batches(documents.sparkSession)
    spans = repeated_spans(documents)
    others = [c for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*(documents[c] for c in others)).alias("row"), documents["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(documents)).alias("digest"), packed(documents["text"].cast("string")).alias("packed"))
    both = _meet(rows, spans, "left").select("row", kept(F.col("packed"), F.col("spans")).alias("text"))
    return both.select(*((F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in documents.columns))


def repeat_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for packed_, spans in zip(b.column("packed").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data, runs = unpacked(packed_), united(spans)
                kept = without(data, runs)
                made.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            if made:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_batches(_meet(_packed(_texts(documents)), repeated_spans(documents), "left"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(read(spark, sf_dir, "documents"))
