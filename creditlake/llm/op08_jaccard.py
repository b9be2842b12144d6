"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more, and what they connect.

Sets of at least 3/4 of each other's size that are that similar differ in at most τ = (|r| + |s|) / 7 shingles. Sizes are cut into
bands by the factor 4/3; a document is indexed in its own band and, as the larger of a pair, in the one below. Each band splits the
universe of shingles by hash into more segments than τ, so by the pigeonhole principle at least one non-empty segment of the
smaller set is the same in the larger one. Empty segments are not indexed; where that leaves a set no more than τ segments, it is
the smaller of a pair under the next hash seed instead, so no pair is lost. In bands of short documents, where segments are nearly
single shingles, those with two or more also index what is left by one deletion.

Signatures of segments are exchanged in packed form, by hash; a task reads a bucket and sees which sets share a signature.

* Groups of up to GROUP sets give stars: links between their smallest set and the others. Links are verified exactly on the texts.
* Larger groups come from frequent passages or large families. There, cost decides what a set probes: it leaves out the frequent
  segments if more than τ others remain (``_needs``), as most sets can. For those that can't, each group has a hub h, the set whose
  segments are the most common ones, and members x are compared with h once: D(x) = x △ h. As |a △ b| = |D(a) △ D(b)|,
  two sets that aren't both linked to h are similar only if D(a) and D(b) share (7|D(a)| + 7|D(b)| - |a| - |b|) / 14 shingles or
  more, which is above 0. So they share one among the first of each, in any order that both follow (``_differences``). Around a hub
  of many members the rarest come first, by how many of a share of the members differ from h in them (``_tables``), so what a part of the family
  has in common beside h is met only by sets with little else; around others the shingles that h lacks come first. That meeting by
  shingles takes the place of pairing a group's members.
* What the verified links connect is one component; groups that lie in more than one then give the pairs between components. A
  similar pair shares all of the smaller set's non-empty segments but τ, so pairs that share fewer, with those it has in larger
  groups and doesn't probe counted in their favour, can't be similar; the others are verified exactly. This step misses nothing, so the stars before
  it only save work.

Equal sets are one node throughout, named by 64 bits of a digest. Defined cases: null, empty or blank text has an empty set
(n_shingles 0), linked with nothing; a null doc_id has its own row, takes part in links, and is the component's id only if no other
member has an id; rows that repeat a doc_id are rows of their own; an empty table gives no rows; other columns are ignored, or pass
through ``keep_representatives``.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditlake.llm.common import map_batches, only, partitions, read, small_batches, staged, text_of
from creditlake.llm.components import connected
from creditlake.llm.shingles import mix, shingles

#: Similarity as a fraction, sets in a group that may be paired with each other, signatures and sets a task packs at once.
UP, DOWN, GROUP, FLUSH, SETS = 3, 4, 32, 2_000_000, 60_000
SHORT, SHORT_SEGMENTS = 64, 1024
#: Members of a leader that one task compares; shingles of a hub that meet in one part.
DEALT, MEET = 256, 1_000_000
#: Hubs of more members have their shingles put in order by a count over one of SAMPLED members, if LEAST of those differ in one.
LARGE, SAMPLED, LEAST = 512, 8, 4
_SET = np.dtype([("set", "<i8"), ("size", "<u4"), ("common", "<u2")])


def name(tokens: np.ndarray) -> int | None:
    """A set's name: 64 bits of a digest of its sorted hashes."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


def similar(r: np.ndarray, s: np.ndarray) -> bool:
    both = len(np.intersect1d(r, s, assume_unique=True))
    return DOWN * both >= UP * (len(r) + len(s) - both)


def difference(size: int) -> int:
    """The most shingles by which a similar, larger set can differ from one of this size."""
    return (size + DOWN * size // UP) // 7


@lru_cache(maxsize=512)
def floor_of(band: int) -> int:
    """The least size in a band; every band's least is at least 3/4 of the next one's."""
    return 1 if band == 0 else max(floor_of(band - 1) + 1, DOWN * floor_of(band - 1) // UP)


def band_of(size: int) -> int:
    band = max(0, int(math.log(size) / math.log(DOWN / UP)) - 6)
    while floor_of(band + 1) <= size:
        band += 1
    while floor_of(band) > size:
        band -= 1
    return band


def segments(band: int) -> int:
    least = floor_of(band)
    return SHORT_SEGMENTS if least < SHORT else math.ceil(0.52 * least + 2 * math.sqrt(least))


def _segment_of(tokens: np.ndarray, band: int, seed: int) -> np.ndarray:
    return (mix(tokens + np.uint64(seed)) if seed else tokens) % np.uint64(segments(band))


def placed(tokens: np.ndarray) -> tuple[int, int]:
    """The first seed under which more segments are filled than a similar set can differ in, and how many are filled."""
    band, most = band_of(len(tokens)), difference(len(tokens))
    for seed in itertools.count():
        filled = int(np.count_nonzero(np.bincount(_segment_of(tokens, band, seed).astype(np.int64), minlength=1)))
        if filled > most:
            return seed, filled
    raise AssertionError


def signatures(tokens: np.ndarray, band: int, seed: int = 0) -> np.ndarray:
    """One for each non-empty segment; in short bands also one for each deletion from a segment of two or more."""
    segment = _segment_of(tokens, band, seed)
    order = np.argsort(segment, kind="stable")
    segment, mixed = segment[order], mix(tokens[order])
    starts = np.flatnonzero(np.diff(segment, prepend=np.uint64(1 << 63)))
    sums = np.add.reduceat(mixed, starts)
    salt = segment[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + (seed << 32))
    full = mix(sums + salt)
    if floor_of(band) >= SHORT:
        return full
    count = np.diff(np.append(starts, len(segment)))
    each = np.repeat(np.arange(len(starts)), count)
    many = count[each] > 1
    return np.concatenate([full, mix((sums + salt)[each[many]] - mixed[many])])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = b.column("text").to_pylist()
        sets = [shingles(t) for t in texts]
        at = [placed(s) if len(s) else (0, 0) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("digest"), pa.array([len(s) for s in sets], pa.int64()), pa.array([name(s) for s in sets], pa.int64()), pa.array([band_of(len(s)) if len(s) else None for s in sets], pa.int32()),
             pa.array([a[0] for a in at], pa.int32()), pa.array([a[1] for a in at], pa.int32()), pa.array([packer.compress(t.encode()) for t in texts], pa.binary())],
            ["doc_id", "digest", "n_shingles", "set", "band", "seed", "filled", "packed"])


_MEMBERS = "doc_id long, digest long, n_shingles long, set long, band int, seed int, filled int, packed binary"


def _packed(buckets: int, seed: int, bands: set[int] | None):
    """Rows (bucket, payload): a table of the sets that have signatures in the bucket, then whose each signature is and in which role, then 5 bytes of each, sorted.

    Of a seed other than the first, only sets of the bands that need it.
    """

    def flush(sets: list[tuple[int, int, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(s[2]) for s in sets])
        signs = np.concatenate([s[2] for s in sets])
        owner = np.repeat(np.arange(len(sets)), lengths)
        own = np.arange(len(signs)) - np.repeat(np.cumsum(lengths) - lengths, lengths) < np.repeat([s[3] for s in sets], lengths)
        order = np.argsort(signs)
        signs, owner, own = signs[order], owner[order], own[order]
        starts = np.flatnonzero(np.concatenate([[True], signs[1:] != signs[:-1]]))
        others = np.repeat(np.diff(np.append(starts, len(signs))), np.diff(np.append(starts, len(signs)))) - 1
        common = np.minimum(np.bincount(owner, others, len(sets)), 65_535)
        table = np.zeros(len(sets), _SET)
        table["set"], table["size"], table["common"] = [s[0] for s in sets], [s[1] for s in sets], common
        edges = np.searchsorted((signs >> np.uint64(40)).astype(np.int64) * buckets >> 24, np.arange(buckets + 1))
        out = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[k], edges[k + 1])
            who, place = np.unique(owner[part], return_inverse=True)
            five = signs[part].view(np.uint8).reshape(-1, 8)[:, :5]
            out.append((k, len(who).to_bytes(4, "little") + len(place).to_bytes(4, "little") + table[who].tobytes() + place.astype("<u2").tobytes() + np.packbits(own[part]).tobytes() + five.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary())], ["bucket", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held, seen = [], 0, set()
        for b in batches:
            for text in b.column("text").to_pylist():
                tokens = shingles(text)
                if (who := name(tokens)) is None or who in seen:
                    continue
                band = band_of(len(tokens))
                if bands is not None and band not in bands and band - 1 not in bands:
                    continue
                seen.add(who)
                signs = [signatures(tokens, k, seed) for k in (band, band - 1)[: 1 + (band > 0)]]
                sets.append((who, len(tokens), np.concatenate(signs), len(signs[0]) if placed(tokens)[0] == seed else 0))
                held += len(sets[-1][2])
                if held >= FLUSH or len(sets) >= SETS:
                    yield from flush(sets)
                    sets, held, seen = [], 0, set()
        if sets:
            yield from flush(sets)

    return run


#: What a bucket gives: a group of up to GROUP sets and in how many signatures it was seen; or a set, the hub of larger groups it is in, and in how many of those it can be the smaller of a pair.
_MEMBER = pa.struct([("id", pa.int64()), ("size", pa.int32()), ("own", pa.bool_())])
_FOUND = pa.schema([("members", pa.list_(_MEMBER)), ("hub", pa.int64()), ("set", pa.int64()), ("size", pa.int32()), ("seen", pa.int32())])
_FOUND_DDL = "members array<struct<id:long,size:int,own:boolean>>, hub long, set long, size int, seen int"


def _bucket_groups(payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
    tables, signs, owners, owns, base = [], [], [], [], 0
    for p in payloads:
        n, m = int.from_bytes(p[:4], "little"), int.from_bytes(p[4:8], "little")
        at = 8 + n * _SET.itemsize
        tables.append(np.frombuffer(p, _SET, n, 8))
        owners.append(np.frombuffer(p, "<u2", m, at).astype(np.int64) + base)
        bits = (m + 7) // 8
        owns.append(np.unpackbits(np.frombuffer(p, np.uint8, bits, at + 2 * m), count=m))
        wide = np.zeros((m, 8), np.uint8)
        wide[:, :5] = np.frombuffer(p, np.uint8, offset=at + 2 * m + bits).reshape(-1, 5)
        signs.append(wide.view("<u8").ravel())
        base += n
    table, sign, owner, own = np.concatenate(tables), np.concatenate(signs), np.concatenate(owners), np.concatenate(owns)
    order = np.argsort(sign, kind="stable")
    sign = sign[order]
    again = sign[1:] == sign[:-1]
    shared = np.concatenate([again, [False]]) | np.concatenate([[False], again])
    sign, owner, own = sign[shared], owner[order[shared]], own[order[shared]]
    if not len(sign):
        return
    every, node = np.unique(table["set"][owner], return_inverse=True)
    size, common = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    size[node] = table["size"][owner]
    np.maximum.at(common, node, table["common"][owner].astype(np.int64))
    order = np.lexsort((1 - own, node, size[node], sign))
    sign, node, own = sign[order], node[order], own[order]
    fresh = np.concatenate([[True], (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])])  # copies are one member
    sign, node, own = sign[fresh], node[fresh], own[fresh]
    starts = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
    lengths = np.diff(np.append(starts, len(sign)))
    good = (lengths > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0)  # a smaller set of a pair is always in its own band
    starts, lengths = starts[good], lengths[good]
    code = 2 * node + own
    for n in np.unique(lengths[lengths <= GROUP]).tolist():
        groups, seen = np.unique(code[starts[lengths == n][:, None] + np.arange(n)], axis=0, return_counts=True)
        flat = groups.ravel()
        for k in range(0, len(groups), 8192):
            part = flat[k * n : (k + 8192) * n]
            some = len(part) // n
            members = pa.StructArray.from_arrays([pa.array(every[part >> 1]), pa.array(size[part >> 1].astype(np.int32)), pa.array((part & 1).astype(bool))], fields=list(_MEMBER))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(some + 1, dtype=np.int32) * n), members).cast(_FOUND.field("members").type)
            yield pa.RecordBatch.from_arrays([lists, *(pa.nulls(some, _FOUND.field(c).type) for c in ("hub", "set", "size")), pa.array(seen[k : k + 8192].astype(np.int32))], schema=_FOUND)
    pairs, roles = [], []
    for at, n in zip(starts[lengths > GROUP].tolist(), lengths[lengths > GROUP].tolist(), strict=True):
        group = node[at : at + n]
        pairs.append(group[np.lexsort((every[group], common[group]))[-1]] * len(every) + group)
        roles.append(own[at : at + n])
    if pairs:
        both, place = np.unique(np.concatenate(pairs), return_inverse=True)
        seen = np.bincount(place, np.concatenate(roles), len(both)).astype(np.int32)
        hub, member = both // len(every), both % len(every)
        for k in range(0, len(both), 8192):
            part = slice(k, k + 8192)
            columns = [pa.nulls(len(both[part]), _FOUND.field("members").type), pa.array(every[hub[part]]), pa.array(every[member[part]]), pa.array(size[member[part]].astype(np.int32)), pa.array(seen[part])]
            yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket."""
    rows = (r for b in batches for r in zip(b.column("bucket").to_pylist(), b.column("payload").to_pylist(), strict=True))
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield from _bucket_groups([p for _, p in group])


def _beside_leader(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int, np.ndarray, bool, int, np.ndarray | None]]:
    """Rows sorted by leader, its table and its own text first → leader and member with their shingles, the leader's number of deals and its table."""
    reader = zstandard.ZstdDecompressor()
    leader, tokens, table, holder = None, None, None, None
    for b in batches:
        for a, other, packed, asks, parts, frequent in zip(*(b.column(c).to_pylist() for c in ("leader", "set", "packed", "asks", "parts")), b.column("table").to_numpy(zero_copy_only=False), strict=True):
            if other is None:
                holder, table = a, np.asarray(frequent, np.int64)
                continue
            own = shingles(reader.decompress(packed).decode())
            if a == other:
                leader, tokens = a, own
                table = table if holder == a else None
            elif a == leader:
                yield a, tokens, other, own, asks, parts, table


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that hold."""
    for part in itertools.batched(((a, b) for a, x, b, y, *_ in _beside_leader(batches) if similar(x, y)), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], ["a", "b"])


def differences(h: np.ndarray, x: np.ndarray) -> tuple[bool, int, int, int, np.ndarray]:
    """Whether x is linked to h; |D| of D = x △ h; how many of D a set that isn't linked has to share one of; how many any set has to; D.

    With a partner that isn't linked, 7|D(a)| + |h| - |a| + 1 fourteenths at least are shared; with one that is linked, 7|D(a)| - |a|
    - |h| + 6 at least.
    """
    mine, hubs = np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)
    d = len(mine) + len(hubs)
    linked = 7 * d <= len(x) + len(h)
    near = d - max(1, -(-(7 * d + len(h) - len(x) + 1) // 14)) + 1
    far = d - max(1, -(-(7 * d - len(h) - len(x) + 6) // 14)) + 1
    return linked, d, near, min(d, max(0, near if linked else far)), np.concatenate([mine, hubs])


def first_differences(h: np.ndarray, x: np.ndarray) -> tuple[bool, int, int, np.ndarray]:
    """``differences`` with D as far as any set has to share one, those that h lacks first."""
    linked, d, near, first, tokens = differences(h, x)
    return linked, d, near, tokens[:first]


_DIFFER = pa.schema([("hub", pa.int64()), ("set", pa.int64()), ("size", pa.int32()), ("asks", pa.bool_()), ("linked", pa.bool_()), ("d", pa.int32()), ("near", pa.int32()), ("tokens", pa.list_(pa.int64()))])
_DIFFER_DDL = "hub long, set long, size int, asks boolean, linked boolean, d int, near int, tokens array<long>"


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member's first differences from its leader, in the order of the leader's table if it has one."""
    for part in itertools.batched(_beside_leader(batches), 256):
        made, tables = [], [p[6] for p in part]
        for k, (_, h, _, x, *_) in enumerate(part):
            linked, d, near, first, tokens = differences(h, x)
            tokens = tokens.view(np.int64)
            if tables[k] is not None:
                if not k or tables[k] is not tables[k - 1]:
                    ordered = rank_order(tables[k])
                tokens = ordered(tokens)
            made.append((linked, d, near, tokens[:first]))
        columns = [[p[0] for p in part], [p[2] for p in part], [len(p[3]) for p in part], [p[4] for p in part], *zip(*made, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _DIFFER, strict=True)], schema=_DIFFER)


def rank_order(table: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Puts shingles in order: those that the table lacks by hash, then the table's in its order."""
    by_hash = np.argsort(table)
    known = table[by_hash]

    def ordered(tokens: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(tokens), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
            rank = np.where(known[at] == tokens, by_hash[at] + 1, 0)
        return tokens[np.lexsort((tokens, rank))]

    return ordered


_COUNTED = pa.schema([("hub", pa.int64()), ("piece", pa.int32()), ("pieces", pa.int32()), ("tokens", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
_COUNTED_DDL = "hub long, piece int, pieces int, tokens array<long>, counts array<int>"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members beside their leader → how many of a deal differ in each shingle, in as many pieces by shingle as the leader has deals."""
    for hub, members in itertools.groupby(_beside_leader(batches), key=lambda r: r[0]):
        for some in itertools.batched(members, DEALT):
            tokens, counts = np.unique(np.concatenate([differences(h, x)[4] for _, h, _, x, *_ in some]), return_counts=True)
            pieces = some[0][5]
            piece = tokens % np.uint64(pieces)
            rows = [(hub, k, pieces, tokens[piece == k].view(np.int64), counts[piece == k].astype(np.int32)) for k in np.unique(piece).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*rows, strict=True)), _COUNTED, strict=True)], schema=_COUNTED)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _COUNTED sorted by hub and piece → one row a piece, with the frequent shingles only."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in _COUNTED.names[:3]), *(b.column(c).to_numpy(zero_copy_only=False) for c in _COUNTED.names[3:]), strict=True))
    for (hub, piece, pieces), group in itertools.groupby(rows, key=lambda r: r[:3]):
        held = list(group)
        tokens, at = np.unique(np.concatenate([r[3] for r in held]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([r[4] for r in held]), len(tokens)).astype(np.int32)
        often = counts >= max(LEAST, pieces)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([hub], [piece], [pieces], [tokens[often]], [counts[often]]), _COUNTED, strict=True)], schema=_COUNTED)


def _tables(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """hub, table: shingles in which many members of a large hub differ from it, the rarest first.

    Any order that all members follow gives the same links; this one decides what that costs, so a count over one of SAMPLED members
    is enough. A shingle has to be in a DEALT-th of those at least, so a table has at most DEALT times as many entries as a member
    has differences, and all copies of it, one for each deal of DEALT members, are no more than all members' differences.
    """
    large = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("a")
    some = pairs.where(F.pmod(F.xxhash64("b", F.lit(SAMPLED)), F.lit(SAMPLED)) == 0).join(large, "a", "left_semi")
    counted = _dealt(some, texts).mapInArrow(_counted, _COUNTED_DDL).repartition(partitions(pairs), "hub", "piece").sortWithinPartitions("hub", "piece")
    pieces = counted.mapInArrow(_summed, _COUNTED_DDL).where(F.size("tokens") > 0)
    tables = pieces.groupBy("hub").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("counts", "tokens")))).alias("found"))
    return staged(tables.select("hub", F.col("found.tokens").alias("table")), "tables")


def _dealt(pairs: DataFrame, texts: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """leader, set, asks, parts, packed, table: members (a, b, asks) of each leader, DEALT to a task, each time with the leader's table (no set) and own text before them."""
    pairs = staged(pairs, "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts"))
    wide = pairs.join(parts, "a").select(F.col("a").alias("leader"), F.col("b").alias("set"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "parts", "asks")
    want = wide.unionByName(wide.select("leader", F.col("leader").alias("set"), "part", "parts", F.lit(False).alias("asks")).distinct())
    met = want.join(texts.hint("merge"), "set").withColumn("table", F.lit(None).cast("array<long>"))
    if tables is not None:
        each = tables.join(parts, tables["hub"] == parts["a"]).select(F.col("hub").alias("leader"), "parts", "table")
        each = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = met.unionByName(each, allowMissingColumns=True)
    dealt = met.repartition(partitions(pairs), "leader", "part").sortWithinPartitions("leader", "part", F.col("set").isNotNull(), F.col("leader") != F.col("set"))
    return dealt.select("leader", "set", "asks", "parts", "packed", "table")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar; each text goes to a task once for each of its leaders."""
    return _dealt(pairs.select("a", "b").distinct().withColumn("asks", F.lit(False)), texts).mapInArrow(_verify, "a long, b long")


def similarity_components(documents: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, set (null if empty), root (the least set that it reaches by links)."""
    small_batches(documents.sparkSession)
    text = text_of(documents)
    docs = only(documents, doc_id=documents["doc_id"].cast("long"), digest=F.xxhash64(text), text=text)
    n = partitions(docs)
    members = staged(map_batches(docs, _described, _MEMBERS), "sets")
    found = None
    for seed in itertools.count():
        bands = {r.band for r in members.where(F.col("seed") >= seed).select("band").distinct().collect()} if seed else None  # some dozens at most
        if seed and not bands:
            break
        signed = map_batches(docs.select("text"), _packed(n, seed, bands), "bucket int, payload binary")
        more = staged(signed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_groups, _FOUND_DDL), "groups")
        found = more if found is None else found.unionByName(more)
    small = staged(found.where("members is not null").groupBy("members").agg(F.sum("seen").alias("seen")), "small")
    hubs = _hubs(found.where("hub is not null").groupBy("hub", "set").agg(F.sum("seen").alias("seen")))
    needs = staged(_needs(hubs, members), "needs")
    asked = staged(_asked(hubs, needs), "asked")
    stars = _stars(small)
    wanted = small.select(F.explode("members.id").alias("set")).unionByName(asked.select("set")).unionByName(asked.select(F.col("hub").alias("set"))).distinct()
    texts = staged(members.select("set", "packed").join(wanted.hint("merge"), "set").groupBy("set").agg(F.first("packed").alias("packed")), "texts")
    beside = staged(asked.where("hub <> set").select(F.col("hub").alias("a"), F.col("set").alias("b"), "asks"), "beside")
    differ = staged(_dealt(beside, texts, _tables(beside, texts)).mapInArrow(_differ, _DIFFER_DDL), "differ")
    roots = connected(verified(stars, texts).unionByName(differ.where("linked").select(F.col("hub").alias("a"), F.col("set").alias("b"))))
    more = staged(verified(_between(small, roots, needs).unionByName(_differences(differ, roots)), texts), "links")
    if more.limit(1).count():
        roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    r = roots.withColumnRenamed("node", "set")
    return members.join(r.hint("merge"), "set", "left").select("doc_id", "digest", "n_shingles", "set", F.coalesce("root", "set").alias("root"))


def _stars(small: DataFrame) -> DataFrame:
    """a, b: each group's smallest set with the others of fitting size that it shares enough with; the rest is left to ``_between``."""
    first = F.col("members")[0]
    each = small.select(first["id"].alias("a"), first["size"].alias("size_a"), F.explode(F.slice("members", F.lit(2), F.size("members"))).alias("m"), "seen")
    pairs = each.where(UP * F.col("m.size") <= DOWN * F.col("size_a")).groupBy("a", F.col("m.id").alias("b"), "size_a").agg(F.sum("seen").alias("seen"))
    return pairs.where(F.col("seen") >= F.greatest(F.lit(2), F.col("size_a") / 32)).select("a", "b")


def _hubs(hubs: DataFrame) -> DataFrame:
    """hub, set, seen, with the groups of each hub moved to the hub that it is itself a member of with the most others.

    A hub need not be in a group, as long as the group's members are all compared with the same one; so a family has one hub.
    """
    hubs = staged(hubs, "hubs")
    crowd = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("crowd"))
    heads = hubs.join(crowd.select(F.col("hub").alias("set")), "set", "left_semi").select("hub", "set")
    moved = heads.join(crowd, "hub").groupBy(F.col("set").alias("hub")).agg(F.max_by("hub", F.struct("crowd", "hub")).alias("to"))
    return staged(hubs.join(moved, "hub", "left").groupBy(F.coalesce("to", "hub").alias("hub"), "set").agg(F.sum("seen").alias("seen")), "hubs")


def _needs(hubs: DataFrame, members: DataFrame) -> DataFrame:
    """a, n (its size), filled (its segments), asks (it has to probe larger groups), spare (its segments in larger groups that it doesn't probe).

    A larger set that is similar to a has at least ``filled`` less τ of its segments; only if so many are in larger groups can all
    that they share be there.
    """
    counts = hubs.groupBy(F.col("set").alias("a")).agg(F.sum("seen").alias("large"))
    sets = members.where("set is not null").groupBy(F.col("set").alias("a")).agg(F.max("filled").alias("filled"), F.max("n_shingles").alias("n"))
    asks = F.coalesce("large", F.lit(0)) >= F.col("filled") - F.floor((F.col("n") + F.floor(DOWN * F.col("n") / UP)) / 7)
    return sets.join(counts, "a", "left").select("a", "n", "filled", asks.alias("asks"), F.when(asks, 0).otherwise(F.coalesce("large", F.lit(0))).alias("spare"))


def _asked(hubs: DataFrame, needs: DataFrame) -> DataFrame:
    """hub, set, asks: all members of the hubs that some set has to probe, and whether this one has to."""
    asks = hubs.where("seen > 0").join(needs.where("asks").select(F.col("a").alias("set")), "set", "left_semi").select("hub", "set", F.lit(True).alias("asks"))
    all_ = hubs.select("hub", "set").join(asks.select("hub").distinct(), "hub", "left_semi")
    return all_.join(asks, ["hub", "set"], "left").select("hub", "set", F.coalesce("asks", F.lit(False)).alias("asks"))


_LISTED = pa.schema([("hub", pa.int64()), ("part", pa.int32()), ("set", pa.int64()), ("root", pa.int64()), ("size", pa.int32()), ("asks", pa.bool_()), ("linked", pa.bool_()), ("d", pa.int32()), ("near", pa.int32()), ("listed", pa.int32()), ("tokens", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])
_LISTED_DDL = "hub long, part int, set long, root long, size int, asks boolean, linked boolean, d int, near int, listed int, tokens array<long>, at array<int>"


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of differences, those of large hubs cut into parts by shingle, with the place of each shingle in its list."""
    for b in batches:
        rows, parts, tokens, places = [], [], [], []
        for i, (n, row) in enumerate(zip(b.column("parts").to_pylist(), b.column("tokens").to_numpy(zero_copy_only=False), strict=True)):
            row = np.asarray(row, np.int64)
            part = row.view(np.uint64) % np.uint64(n)
            for k in np.unique(part).tolist():
                at = np.flatnonzero(part == k)
                rows.append(i)
                parts.append(k)
                tokens.append(row[at])
                places.append(at.astype(np.int32))
        if rows:
            take = pa.array(rows, pa.int32())
            columns = {"part": pa.array(parts, pa.int32()), "tokens": pa.array(tokens, pa.list_(pa.int64())), "at": pa.array(places, pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_arrays([columns.get(c) if c in columns else b.column(c).take(take) for c in _LISTED.names], schema=_LISTED)


def meeting_pairs(rows: dict[str, np.ndarray], tokens: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """Of members of one hub, the pairs (i, j) in different components that share a shingle early enough in both lists.

    Two linked sets are in one component. Two that aren't have to share one of the first ``near``; one that is, with any of the other's.
    A shingle of a single component gives nothing, and one of a large component and others only what crosses between them.
    """
    n = len(tokens)
    owner = np.repeat(np.arange(n), [len(t) for t in tokens])
    token, at = np.concatenate(tokens), np.concatenate(places).astype(np.int64)
    order = np.argsort(token, kind="stable")
    token, at, owner = token[order], at[order], owner[order]
    root, size, asks, linked, d = (rows[c] for c in ("root", "size", "asks", "linked", "d"))
    close = at < rows["near"][owner]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    lengths = np.diff(np.append(starts, len(token)))
    roots = root[owner]
    live = (lengths > 1) & (np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)) & np.logical_or.reduceat(asks[owner], starts)
    found = [np.zeros(0, np.int64)]

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        a, b = owner[i], owner[j]
        t = -((size[a] + size[b] - 7 * (d[a] + d[b])) // 14)
        good = (root[a] != root[b]) & ~(linked[a] & linked[b]) & (at[i] + t <= d[a]) & (at[j] + t <= d[b]) & (linked[a] | linked[b] | (close[i] & close[j]))
        good &= (UP * np.maximum(size[a], size[b]) <= DOWN * np.minimum(size[a], size[b])) & ((asks[a] & (size[a] <= size[b])) | (asks[b] & (size[b] <= size[a])))
        found.append(np.unique(np.minimum(a[good], b[good]) * n + np.maximum(a[good], b[good])))

    for m in np.unique(lengths[live & (lengths <= GROUP)]).tolist():
        x, y = np.triu_indices(m, 1)
        for first in np.array_split(starts[live & (lengths == m)], 1 + int((live & (lengths == m)).sum()) * len(x) // 1_000_000):
            keep((first[:, None] + x).ravel(), (first[:, None] + y).ravel())
    for first, m in zip(starts[live & (lengths > GROUP)].tolist(), lengths[live & (lengths > GROUP)].tolist(), strict=True):
        run = np.arange(first, first + m)
        names, counts = np.unique(roots[run], return_counts=True)
        some = run[roots[run] != names[counts.argmax()]]
        far = 7 * d[owner[run]] - size[owner[run]]
        run = run[np.argsort(far, kind="stable")]
        far.sort()
        # a pair fits only if 14 at(i) - 7 d(i) - size(i) + far(j) is 0 at most
        reach = np.searchsorted(far, 7 * d[owner[some]] + size[owner[some]] - 14 * at[some], "right")
        for part in np.array_split(np.arange(len(some)), 1 + int(reach.sum()) // 1_000_000):
            k = reach[part]
            keep(np.repeat(some[part], k), run[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)])
    both = np.unique(np.concatenate(found))
    met = np.stack([both // n, both % n], 1)
    listed = rows["listed"]
    if len(met) and (listed == [len(t) for t in tokens]).all():  # whole lists: what both hold, and what the longer rest could add, has to be enough
        t = -((size[met].sum(1) - 7 * d[met].sum(1)) // 14)
        rest = np.maximum(0, (d[met] - listed[met]).max(1))
        met = met[_shared(tokens, met) + rest >= t]
    return met


def _shared(tokens: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """How many tokens the lists of each pair share, without repeats within a list; about a million tokens at once."""
    count = np.array([len(t) for t in tokens])
    start, flat = np.cumsum(count) - count, np.concatenate(tokens)
    out = np.zeros(len(pairs), np.int64)
    for part in np.array_split(np.arange(len(pairs)), 1 + int(count[pairs].sum()) // 1_000_000):
        who = pairs[part].ravel()
        k = count[who]
        token = flat[np.repeat(start[who] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        pair = np.repeat(np.repeat(part, 2), k)
        order = np.lexsort((token, pair))
        same = (token[order][1:] == token[order][:-1]) & (pair[order][1:] == pair[order][:-1])
        out[part] = np.bincount(pair[order][1:][same] - part[0], minlength=len(part)) if len(part) else 0
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _LISTED sorted by hub and part → hub, set_a, set_b."""

    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held, _LISTED)
        rows = {c: t.column(c).to_numpy() for c in _LISTED.names[2:10]}
        rows |= {c: rows[c].astype(np.int64) for c in ("size", "d", "near", "listed")} | {c: rows[c].astype(bool) for c in ("asks", "linked")}
        met = meeting_pairs(rows, t.column("tokens").to_numpy(), t.column("at").to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(met), t.column("hub")[0].as_py(), np.int64)), *(pa.array(rows["set"][met[:, k]]) for k in (0, 1))], ["hub", "set_a", "set_b"])

    held, key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        hub, part = b.column("hub").to_numpy(), b.column("part").to_numpy()
        edges = [0, *(np.flatnonzero((hub[1:] != hub[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(hub)]
        for a, e in itertools.pairwise(edges):
            if held and key != (hub[a], part[a]):
                yield pairs(held)
                held = []
            key = hub[a], part[a]
            held.append(b.slice(a, e - a).select(_LISTED.names))
    if held:
        yield pairs(held)


def _differences(differ: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: sets of one hub, in different components, whose differences from it can share enough.

    Lists meet by hub, those of a large hub in parts of about MEET shingles. Of the pairs that share one early enough those stay that
    can share enough: what both lists hold, and what the longer rest that isn't listed could add.
    """
    # |D(b)| is at most |D(a)| + (|a| + |b|) / 7; what is farther from the hub than any set that asks allows is left out.
    listed = F.size("tokens")
    reach = differ.groupBy("hub").agg(F.max(F.when(F.col("asks"), 7 * F.col("d") + F.col("size"))).alias("reach"), F.ceil((F.sum(listed.cast("long")) + 1) / MEET).cast("int").alias("parts"))
    near = differ.join(reach, "hub").where((7 * F.col("d") - F.col("size") <= F.col("reach")) & (listed > 0))
    rooted = near.join(roots.select(F.col("node").alias("set"), "root"), "set", "left").withColumns({"root": F.coalesce("root", "set"), "listed": listed})
    dealt = map_batches(rooted, _parted, _LISTED_DDL).repartition(partitions(differ), "hub", "part").sortWithinPartitions("hub", "part")
    met = dealt.mapInArrow(_meet, "hub long, set_a long, set_b long").distinct()
    for mark in "ab":
        side = differ.select("hub", *(F.col(c).alias(f"{c}_{mark}") for c in ("set", "size", "d", "tokens")))
        met = met.join(side.hint("merge"), ["hub", f"set_{mark}"])
    t = F.ceil((7 * (F.col("d_a") + F.col("d_b")) - F.col("size_a") - F.col("size_b")) / 14)
    rest = F.greatest(F.lit(0), F.col("d_a") - F.size("tokens_a"), F.col("d_b") - F.size("tokens_b"))
    enough = met.where(F.size(F.array_intersect("tokens_a", "tokens_b")) + rest >= t)
    return enough.select(F.col("set_a").alias("a"), F.col("set_b").alias("b")).distinct()


#: Members are sorted by size; the smaller of a pair has to be in its own band.
_PAIRS = """filter(flatten(transform(xs, (x, i) -> transform(slice(xs, i + 2, size(xs)), y -> struct(x as r, y as s)))),
  p -> p.r.own and p.r.root <> p.s.root and 3 * p.s.size <= 4 * p.r.size)"""


def _between(small: DataFrame, roots: DataFrame, needs: DataFrame) -> DataFrame:
    """a, b: sets in different components that can be similar by the signatures they share in groups of up to GROUP."""
    r = roots.select(F.col("node").alias("a"), "root")
    each = small.withColumn("group", F.xxhash64("members")).select("group", "seen", F.explode("members").alias("m")).select("group", "seen", F.col("m.id").alias("a"), "m.size", "m.own").join(r, "a", "left")
    each = each.select("group", "seen", F.struct("size", F.coalesce("root", "a").alias("root"), "own", "a").alias("x"))
    split = each.groupBy("group", "seen").agg(F.min("x.root").alias("lo"), F.max("x.root").alias("hi"), F.array_sort(F.collect_list("x")).alias("xs")).where("lo <> hi")
    pairs = split.select("seen", F.explode(F.expr(_PAIRS)).alias("p")).select(F.col("p.r.a").alias("a"), F.col("p.s.a").alias("b"), F.col("p.s.size").alias("size_b"), "seen")
    shared = pairs.groupBy("a", "b").agg(F.max("size_b").alias("size_b"), F.sum("seen").alias("seen")).join(needs, "a")
    return shared.where(F.col("seen") + F.col("spare") >= F.col("filled") - F.floor((F.col("n") + F.col("size_b")) / 7)).select("a", "b")


def _first_of(columns: list[str]) -> Column:
    """The least row by these columns, nulls last."""
    return F.min(F.struct(*(x for c in columns for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c)))))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    found = similarity_components(documents)
    least = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found.join(least.hint("merge"), "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(documents: DataFrame) -> DataFrame:
    """documents, all columns: of each component only the row of its least doc_id (nulls last), of several the one of the least text hash.

    Rows that repeat both stay together, as do rows with an empty set.
    """
    found = staged(similarity_components(documents).where(F.col("root").isNotNull()).select("root", "doc_id", "digest").distinct(), "members")
    first = found.groupBy("root").agg(_first_of(["doc_id", "digest"]).alias("first"))
    other = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("digest") != F.col("first.digest"))
    gone = found.join(first.hint("merge"), "root").where(other).select(F.col("doc_id").alias("_doc_gone"), F.col("digest").alias("_digest_gone"))
    kept = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("row"), documents["doc_id"].cast("long").alias("id"), F.xxhash64(text_of(documents)).alias("hash"))
    kept = kept.join(gone.hint("merge"), kept["id"].eqNullSafe(gone["_doc_gone"]) & (kept["hash"] == gone["_digest_gone"]), "left_anti")
    return kept.select("row.*")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
