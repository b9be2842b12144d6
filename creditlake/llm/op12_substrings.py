"""Substring dedup by relative Lempel-Ziv parsing: words covered by WINDOW words in a row that also start anywhere else go.

1. ``repeated_anchors``: every window owns an anchor, the start of its GRAM words of least hash, so a window can only repeat if the
   gram at its anchor does. Anchors are dealt in order of their hash (``Ranges``) and sorted; a task streams them and decides each gram
   by its number of rows: one is left out, HOT or more are marked. Only the first and the last gram of a task can go on in a
   neighbour, so their rows wait for totals taken over those two a task, which bounds what is broadcast.
2. ``pieces``: the words around each repeated anchor, as far as its windows reach, go to the reference block of the gram's hash, so
   all that a document's windows could repeat stands in the blocks that its pieces go to. Equal pieces of a task are one row;
   if they have several owners all their windows repeat, so their spans are known at once and the row goes on without owners.
   A marked gram's windows don't meet in its block but each in the block of its own 128-bit hash, so a frequent gram is spread
   evenly; these windows alone are judged by that hash and not by their words.
3. ``Reference``: a block's distinct pieces are its reference text, indexed by its sorted suffixes. Each piece is factored greedily:
   a factor is the longest match that starts anywhere else in the block. A factor of WINDOW words or more is a duplicate span. A
   repeated window that no factor holds lies over the boundary of two factors, so the windows over each boundary are looked up.

What comes back to the documents is spans. Texts are exchanged as Zstandard, to meet their anchors and then their spans.

Memory: step 2 holds HELD bytes of pieces and hands them on; step 3 holds one block, of which there are BLOCKS a partition.

Defined cases: null, empty and short texts lose nothing; rows that repeat a doc_id and text are two places, so both lose what they
share; a null doc_id is returned as null; an empty table gives no rows; other columns pass through ``remove_substrings``. A text that
loses words becomes its kept words with single blanks between them; others are left as they are.
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
from creditlake.llm.windows import Anchors, mix

WINDOW, GRAM = 35, 8
#: Windows that are worked on at once.
PART = 1 << 20
#: A gram with so many rows is decided window by window.
HOT = 1000
#: Reference blocks a partition of the exchange.
BLOCKS = 16
#: Bytes of pieces and number of hashed windows that a task holds before it hands them on.
HELD, HELD_WINDOWS = 32 << 20, 200_000
_PLACE = np.uint64((1 << 24) - 1)
_FACTORS = np.random.default_rng(31).integers(0, 2**64, GRAM, dtype=np.uint64) | np.uint64(1)


class Hashes(dict):
    """64-bit hashes of words, kept for words that come again."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def anchors(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> Iterator[Anchors]:
    """Anchors of a text's words, part by part: places, gram hashes, first and last window of each; none for less than a window."""
    wide = window - gram + 1
    for start in range(0, max(0, len(hashes) - window + 1), PART):
        h = hashes[start : start + PART + window - 1]
        n = len(h) - gram + 1
        grams = np.zeros(n, np.uint64)
        for k in range(gram):
            grams += h[k : k + n] * _FACTORS[k]
        grams = mix(grams)
        least, span = (grams & ~_PLACE) | np.arange(n, dtype=np.uint64), 1
        while span * 2 <= wide:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if span < wide:
            least = np.minimum(least[: n - wide + 1], least[wide - span : n - span + 1])
        owner = (least & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner)) - 1
        yield Anchors(owner[first] + start, grams[owner[first]], first + start, last + start)


def _spot(docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Spreads the rows of a frequent gram, be they of many documents or of one."""
    return mix(docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64)).view(np.int64)


def _anchor_rows(ranges: Ranges | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            rows, grams, places = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                for a in anchors(hashes.of(text.encode().split())):
                    rows.append(np.full(len(a.at), i, np.int32))
                    grams.append(a.gram.view(np.int64))
                    places.append(a.at)
            if rows:
                at, gram, place = pa.array(np.concatenate(rows)), np.concatenate(grams), np.concatenate(places)
                doc = b.column("doc_id").take(at)
                part = np.zeros(len(gram), np.int32) if ranges is None else ranges.part(gram, _spot(ints(doc), place))
                yield pa.RecordBatch.from_arrays([pa.array(gram), doc, b.column("digest").take(at), pa.array(place.astype(np.int32)), pa.array(part)], ["gram", "doc_id", "digest", "place", "part"])

    return run


def repeated_anchors(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, digest, places: anchors of each document whose gram occurs elsewhere; -1 - place if it is frequent."""
    row, n = "gram long, doc_id long, digest long, place int, part int", partitions(texts)
    known = map_batches(sampled(texts), _anchor_rows(None), row).select("gram", "doc_id", "place").limit(200_000).toArrow()  # bounded; affects the balance only
    ranges = Ranges(known["gram"].to_numpy(), _spot(ints(known["doc_id"].combine_chunks()), known["place"].to_numpy()), n)
    sorted_ = map_batches(texts, _anchor_rows(ranges), row).repartitionById(n, F.col("part")).drop("part").sortWithinPartitions("gram")
    return repeated_places(sorted_, hot)


#: text: words of a piece, or the 16 bytes of a hashed window if windows is 0, or null for a span that is known already. No owner: several, which are known.
_PIECES = pa.schema([("block", pa.int32()), ("text", pa.binary()), ("windows", pa.int32()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("first", pa.int32()), ("many", pa.bool_())])
_PIECES_DDL = "block int, text binary, windows int, doc_id long, digest long, first int, many boolean"


class _Held:
    """Pieces and windows of a task, equal ones once."""

    def __init__(self, blocks: int, window: int):
        self.blocks, self.window = blocks, window
        self.pieces: dict[bytes, list] = {}
        self.hashed: dict[bytes, tuple | None] = {}
        self.bytes = 0

    def add(self, gram: int, text: bytes, windows: int, owner: tuple) -> None:
        if (seen := self.pieces.get(text)) is None:
            self.pieces[text] = [gram % self.blocks, windows, [owner]]
            self.bytes += len(text) + 200
        else:
            seen[2].append(owner)
            self.bytes += 100

    def add_windows(self, words: list[bytes], owner: tuple) -> list[tuple]:
        """Windows of a frequent gram; owners of those that have been seen."""
        known = []
        for k in range(len(words) - self.window + 1):
            key, mine = xxhash.xxh3_128_digest(b" ".join(words[k : k + self.window])), (*owner[:2], owner[2] + k)
            if key in self.hashed:
                known += [x for x in (self.hashed[key], mine) if x is not None]
                self.hashed[key] = None
            else:
                self.hashed[key] = mine
        return known

    def full(self) -> bool:
        return self.bytes >= HELD or len(self.hashed) >= HELD_WINDOWS

    def taken(self, known: list[tuple]) -> Iterator[tuple]:
        """Rows of _PIECES. known: owners of windows that repeat."""
        for text, (block, windows, owners) in self.pieces.items():
            many = len(owners) > 1
            yield block, text, windows, *((None, None, None) if many else owners[0]), many
            if many:
                for o in owners:
                    yield hash(o) % self.blocks, None, windows, *o, False
        for key, owner in self.hashed.items():
            yield int.from_bytes(key[:8], "little") % self.blocks, key, 0, *(owner or (None, None, None)), owner is None
        known.sort()
        for _, run in itertools.groupby(enumerate(known), key=lambda x: (*x[1][:2], x[1][2] - x[0])):
            run = [o for _, o in run]
            yield hash(run[0]) % self.blocks, None, run[-1][2] - run[0][2] + 1, *run[0], False
        self.pieces, self.hashed, self.bytes = {}, {}, 0


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in itertools.batched(rows, 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def _pieces(blocks: int, window: int = WINDOW):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        hashes, held, known = Hashes(), _Held(blocks, window), []
        for b in batches:
            for doc, digest, packed_, places in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "packed", "places")), strict=True):
                words, places = unpacked(packed_).split(), np.array(places)
                often = -1 - places[places < 0]
                wanted = np.append(places[places >= 0], often)
                for a in anchors(hashes.of(words), window):
                    hit = np.flatnonzero(np.isin(a.at, wanted))
                    hot = np.isin(a.at[hit], often) if len(often) else np.zeros(len(hit), bool)
                    for gram, first, last, hashed in zip(a.gram[hit].tolist(), a.first[hit].tolist(), a.last[hit].tolist(), hot.tolist(), strict=True):
                        piece, owner = words[first : last + window], (doc or 0, digest, first)
                        if hashed:
                            known += held.add_windows(piece, owner)
                        else:
                            held.add(gram, b" ".join(piece), last - first + 1, owner)
                    if held.full() or len(known) >= HELD_WINDOWS:
                        yield from held.taken(known)
                        known = []
        yield from held.taken(known)

    return lambda batches: _batched(rows(batches), _PIECES)


class Reference:
    """A block's pieces as one text, each behind a word of its own that no other equals, with its suffixes in order.

    ``longest`` is, for each place, the length of the longest match that starts anywhere else in the block.
    """

    def __init__(self, pieces: list[list[bytes]]):
        sizes = np.array([len(p) for p in pieces])
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        seen: dict[bytes, int] = {}
        n = int(self.ends[-1]) + 1
        text = np.fromiter(itertools.chain.from_iterable((*(seen.setdefault(w, len(seen)) for w in p), -1) for p in pieces), np.int64, n)
        text[self.ends] = len(seen) + np.arange(len(pieces))
        rank, levels, step = np.unique(text, return_inverse=True)[1], [], 1
        while True:
            levels.append(rank.astype(np.int32))
            nxt = np.zeros(n, np.int64)
            nxt[:-step] = rank[step:] + 1
            key = rank * (n + 1) + nxt
            order = np.argsort(key)
            new = np.append(False, key[order[1:]] != key[order[:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if new[1:].all():
                break
            step *= 2
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(n - 1, np.int32)
        for k in range(len(levels) - 1, -1, -1):
            inside = np.flatnonzero((a < n) & (b < n))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            for x in (a, b, common):
                x[same] += 1 << k
        both = np.maximum(np.append(0, common), np.append(common, 0))
        self.longest = np.empty(n, np.int32)
        self.longest[order] = both

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of the greedy factors of all pieces; a word that starts no match is a factor by itself."""
        at, end, places, lengths = self.starts, self.ends, [], []
        while len(at):
            length = np.maximum(1, self.longest[at])
            places.append(at)
            lengths.append(length)
            on = at + length < end
            at, end = (at + length)[on], end[on]
        return np.concatenate(places), np.concatenate(lengths).astype(np.int64)

    def repeated(self, window: int = WINDOW) -> np.ndarray:
        """For each place, whether the window that starts there also starts anywhere else."""
        places, lengths = self.factors()
        hit = np.zeros(len(self.longest) + 1, np.int64)
        long = lengths >= window
        np.add.at(hit, places[long], 1)
        np.add.at(hit, places[long] + lengths[long] - window + 1, -1)
        out = np.cumsum(hit[:-1]) > 0
        over = (places + lengths)[:, None] - np.arange(1, window)[None, :]
        over = over[over >= places[:, None]]  # windows over an earlier boundary too are looked up there
        out[over[self.longest[over] >= window]] = True
        return out


def parsed(rows: Iterator[tuple], window: int = WINDOW) -> Iterator[tuple]:
    """Spans (doc_id, digest, start, end) of repeated words, from the rows (text, windows, doc_id, digest, first, many) of a block."""
    pieces: dict[bytes, list] = {}
    hashed: dict[bytes, tuple | None] = {}
    for text, windows, doc, digest, first, many in rows:
        if text is None:
            yield doc, digest, first, first + windows - 1 + window
        elif not windows:
            mine = None if many else (doc, digest, first)
            for doc_, digest_, first_ in (x for x in (hashed.get(text), mine) if x and text in hashed):
                yield doc_, digest_, first_, first_ + window
            hashed[text] = None if text in hashed else mine
        else:
            seen = pieces.setdefault(text, [windows, [], False])
            seen[2] = seen[2] or many or bool(seen[1])
            if not many:
                seen[1].append((doc, digest, first))
    if not pieces:
        return
    found = Reference([t.split(b" ") for t in pieces])
    repeats = found.repeated(window)
    for start, (windows, owners, many) in zip(found.starts.tolist(), pieces.values(), strict=True):
        hit = repeats[start : start + windows]
        edges = [0, windows] if many else np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0)).tolist()
        for doc, digest, first in owners:
            for a, b in itertools.batched(edges, 2):
                yield doc, digest, first + a, first + b - 1 + window


_SPANS = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in _PIECES.names), strict=True))
    spans = (s for _, block in itertools.groupby(rows, key=lambda r: r[0]) for s in parsed(r[1:] for r in block))
    yield from _batched(spans, _SPANS)


def _texts(documents: DataFrame) -> DataFrame:
    small_batches(documents.sparkSession)
    text = text_of(documents)
    return only(documents, doc_id=F.coalesce(documents["doc_id"].cast("long"), F.lit(0)), digest=_digest(documents), text=text)


def _digest(documents: DataFrame):
    """Tells rows apart that repeat a doc_id, and a null one from 0."""
    return F.xxhash64(text_of(documents), documents["doc_id"].isNull())


def _packed(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "digest", packed(F.col("text")).alias("packed"))


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc_id (0 if null), digest, spans (array of start, end in words, not yet united) of each document that repeats a window."""
    texts = _texts(documents)
    n = partitions(texts)
    pieces = map_batches(_packed(texts).hint("merge").join(repeated_anchors(texts), ["doc_id", "digest"]), _pieces(n * BLOCKS), _PIECES_DDL)
    dealt = pieces.repartition(n, "block").sortWithinPartitions("block")
    spans = dealt.mapInArrow(_parse, "doc_id long, digest long, start int, end int")
    return spans.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def kept(words: list[bytes], spans: list | None) -> list[bytes]:
    """Words that no span covers."""
    at, out = 0, []
    for start, end in sorted((s["start"], s["end"]) for s in (() if spans is None else spans)):
        out += words[at:start]
        at = max(at, end)
    return out + words[at:]


def remove_substrings(documents: DataFrame) -> DataFrame:
    """documents, all columns, without the words that repeated windows cover."""

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda p, s: None if p is None else unpacked(p).decode() if s is None else b" ".join(kept(unpacked(p).split(), s)).decode())

    spans = repeated_spans(documents).withColumnsRenamed({"doc_id": "_doc", "digest": "_digest"})
    others = [c for c in documents.columns if c != "text"]
    rows = documents.select(F.struct(*(documents[c] for c in others)).alias("row"), F.coalesce(documents["doc_id"].cast("long"), F.lit(0)).alias("doc_id"), _digest(documents).alias("digest"), packed(documents["text"].cast("string")).alias("packed"))
    both = rows.hint("merge").join(spans, (rows["doc_id"] == spans["_doc"]) & (rows["digest"] == spans["_digest"]), "left").select("row", cut(F.col("packed"), F.col("spans")).alias("text"))
    return both.select(*((F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in documents.columns))


def substring_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for packed_, spans in zip(b.column("packed").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = unpacked(packed_).split()
                rest = kept(words, spans)
                made.append((len(words), len(words) - len(rest), hashlib.sha256(b" ".join(rest)).hexdigest()))
            if made:
                yield pa.RecordBatch.from_arrays([b.column("own"), *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    own = only(documents, own=documents["doc_id"].cast("long"), doc_id=F.coalesce(documents["doc_id"].cast("long"), F.lit(0)), digest=_digest(documents), packed=packed(text_of(documents)))
    both = own.hint("merge").join(repeated_spans(documents), ["doc_id", "digest"], "left").select("own", "packed", "spans")
    return map_batches(both, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS k FROM (SELECT r, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (
  SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN repeated USING (k)),
word AS (
  SELECT r, i, w[i + 1] AS word FROM (SELECT r, w, unnest(range(len(w))) AS i FROM d)),
rest AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN rest USING (r)
"""
