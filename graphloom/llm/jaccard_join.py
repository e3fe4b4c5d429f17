"""Exact Jaccard self-join of documents on word shingles: a size-aware heavy-light join.

1. One pass over all texts makes the set of 64-bit shingle hashes of each document.
   Half of the hash space (top bit 0) is counted exactly: each block of documents sends
   sorted, packed hashes by hash range, and each range answers how many of a document's
   hashes also occur elsewhere.  A document with a partner at Jaccard T misses at most
   (1 - T) of its set in it, so a document with more lonely hashes than that has no
   partner; most documents end here, none with a link.
2. Equal sets of the rest collapse to the smallest id (their class) by size and two sums that
   the first pass took; only the classes' texts are read again.
3. Light sets (up to a size chosen by cost) enumerate, for each size of a possible
   partner, their subsets of the overlap that the pair needs: sharing one *is* a link.
   Heavy sets put their rarest hashes on inverted lists: the first n - ceil(T n) + 1 in
   one global order, frequent hashes last, so linked sets share a list.
4. Lists are scanned star-wise: each member against the list's centre, exactly verified.
   Verified links make components; only lists that still hold several components are
   scanned again, with other centres.  What may then still link across components is
   settled between classes of equal cores (see `_cross_links`); pairs of documents are
   never formed but with a centre.

Defined results: null, empty and white-space texts have empty sets and are linked with
nothing; fewer than SHINGLE words make one shingle; rows that repeat an id are one
node but all rows come back; a null id has no component; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .components import components
from .store import BROADCAST_IDS, only_ids, plan_bytes, saved, without_ids
from .workers import tidy, tidy_group

SHINGLE = 5
#: Jaccard of NUM / DEN or more.
NUM, DEN = 75, 100
#: Entries and documents that a block sends at once, and input bytes for each hash range.
BLOCK_ENTRIES, BLOCK_DOCS, RANGE_BYTES = 2_000_000, 60_000, 8 << 20
#: A hash in so many documents is frequent; so many frequent ones at most are told to all (only the order depends on them).
FREQUENT, MAX_FREQUENT = 48, 500_000
#: Light sets have at most so many shingles, whatever the cost model says.
MAX_LIGHT = 10
#: Hashes of sets whose prefixes are taken at once, but for a larger set.
KEY_VALUES = 1 << 18
#: Hashes that a block of open sets sends at once, and that a range of them answers for.
OPEN_VALUES = 1 << 20
STAR_ROUNDS = 2
TOP = np.uint64(1 << 63)

_FOLDED = ts.byte_weights(True)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    starts, ends, first = ts.spans(ts.SPACED[data], offsets)
    words = ts.word_hashes(data, starts, ends, _FOLDED)
    grams = ts.gram_hashes(words, k)
    out = []
    for a, b in itertools.pairwise(first.tolist()):
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(ts.mix(ts.gram_hashes(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over the hashes of each set; sets with equal sizes and sums are equal."""
    out = np.zeros((2, len(sets)), np.uint64)
    n = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(n)
    if len(some):
        flat = np.concatenate(sets)
        first = (np.cumsum(n) - n)[some]
        out[0, some] = np.add.reduceat(ts.mix(flat), first)
        out[1, some] = np.bitwise_xor.reduceat(flat * np.uint64(0xD1B54A32D192ED03) ^ flat >> np.uint64(17), first)
    return out[0], out[1]


def overlap_needed(a: int, b: int) -> int:
    """Smallest intersection of sets of a and b elements with DEN * i >= NUM * (a + b - i)."""
    return -(-NUM * (a + b) // (NUM + DEN))


def partner_sizes(n: int) -> range:
    return range(-(-NUM * n // DEN), DEN * n // NUM + 1)


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def subset_count(n: int) -> int:
    return sum(comb(n, overlap_needed(n, b)) for b in partner_sizes(n))


def light_limit(list_length: float) -> int:
    """The largest size for which enumerating subsets costs no more than scanning the lists of the prefix."""
    n = 0
    while n < MAX_LIGHT and subset_count(n + 1) <= 4 * max(list_length, 2.0) * prefix_length(n + 1):
        n += 1
    return n


@lru_cache(maxsize=4096)
def _choices(n: int, c: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), c)), np.int64).reshape(-1, c)


def light_keys(h: np.ndarray, limit: int) -> list[tuple[np.ndarray, int]]:
    """(subset hashes, smaller size of the pair) for each partner size of a pair whose smaller set is light."""
    n, out = len(h), []
    for b in partner_sizes(n):
        small, large = min(n, b), max(n, b)
        if small <= limit:
            c = overlap_needed(small, large)
            parts = ts.mix(h[_choices(n, c)]) if c <= n else np.zeros((0, 1), np.uint64)
            out.append((ts.mix(parts.sum(1) + np.uint64(small * 1000003 + large)), small))
    return out


def _pack(keys: np.ndarray, who: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint32(0)).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + who.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 6
    steps = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").ravel()
    who = np.ascontiguousarray(raw[4 * n :].reshape(2, n).T).view("<u2").ravel()
    return np.cumsum(steps, dtype=np.uint32), who


_SENT = "bucket int, block string, kind string, data binary"


def _send(bits: int):
    """Blocks of (id, text) rows as packed hashes by range, and for each block its table of ids, set sizes and fingerprints."""

    def block(name: str, ids: list, sizes: np.ndarray, sums: np.ndarray, halves: list[np.ndarray]) -> Iterator[tuple[int, str, str, bytes]]:
        sampled = np.array([len(s) for s in halves], np.int64)
        flat = np.concatenate(halves)
        who = np.repeat(np.arange(len(halves), dtype=np.uint16), sampled)
        order = np.argsort(flat)
        flat, who = flat[order], who[order]
        bucket = (flat >> np.uint64(63 - bits)).astype(np.int64)
        key = ((flat >> np.uint64(31 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
        for a, b in itertools.pairwise(edge.tolist()):
            yield int(bucket[a]), name, "hashes", _pack(key[a:b], who[a:b])
        at = int(ts.mix(np.array([hash_name(name)], np.uint64))[0] >> np.uint64(64 - bits))
        known = np.array([x is not None for x in ids])
        table = np.stack([np.array([x or 0 for x in ids], np.int64), known.astype(np.int64), sizes, sampled, *sums.view(np.int64)])
        yield at, name, "table", zstandard.compress(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        sums: list[np.ndarray] = []
        halves: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, ids, sizes, sums, halves, held
            rows = list(block(f"{part}-{serial}", ids, np.array(sizes, np.int64), np.concatenate(sums, axis=1), halves))
            serial, ids, sizes, sums, halves, held = serial + 1, [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.binary()), strict=True)], ["bucket", "block", "kind", "data"])

        for batch in batches:
            for first, end, data, offsets in ts.chunks(*ts.utf8(batch.column(1))):
                more = shingle_sets(data, offsets)
                names = batch.column(0).slice(first, end - first).to_pylist()
                step = BLOCK_DOCS // 2
                for at in range(0, len(more), step):
                    ids += names[at : at + step]
                    sizes += map(len, more[at : at + step])
                    sums.append(np.stack(fingerprints(more[at : at + step])))
                    # sets ascend, so the half with top bit 0 comes first
                    halves += [s[: np.searchsorted(s, TOP)].copy() for s in more[at : at + step]]
                    held += sum(map(len, more[at : at + step]))
                    if held >= BLOCK_ENTRIES or len(ids) >= step:
                        yield flush()
        if ids:
            yield flush()

    return run


def hash_name(name: str) -> int:
    return int.from_bytes(name.encode()[-8:].rjust(8, b"\0"), "little")


def _answer(bits: int):
    """For one hash range: how many of each document's hashes occur in another document, and the frequent hashes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(r.block, "table", r.data) for r in rows.itertuples() if r.kind == "table"]
        sent = rows[rows.kind == "hashes"]
        got = [_unpack(x) for x in sent.data]
        if got:
            key = np.concatenate([x[0] for x in got])
            where = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
            who = np.concatenate([x[1] for x in got]).astype(np.int64)
            order = np.argsort(key)
            ranked = key[order]
            edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
            times = np.diff(edge)
            shared = np.zeros(len(key), bool)
            shared[order] = np.repeat(times > 1, times)
            code = where[shared] << 16 | who[shared]
            pairs, n = np.unique(code, return_counts=True)
            cut = np.searchsorted(pairs >> 16, np.arange(len(got) + 1))
            for i, name in enumerate(sent.block):
                a, b = cut[i], cut[i + 1]
                if b > a:
                    out.append((name, "shared", np.stack([pairs[a:b] & 0xFFFF, n[a:b]]).astype("<u4").tobytes()))
            often = times >= FREQUENT
            top = ranked[edge[:-1][often]].astype(np.uint64) | np.uint64(int(rows.bucket.iloc[0])) << np.uint64(32)
            most = np.argsort(times[often], kind="stable")[::-1][: max(1, 2 * MAX_FREQUENT >> bits)]
            if len(top):
                out.append(("", "frequent", np.stack([top[most], times[often][most].astype(np.uint64)]).tobytes()))
            out.append(("", "lists", np.array([times[times > 1].sum(), (times > 1).sum()], np.int64).tobytes()))
        return pd.DataFrame(out, columns=["block", "kind", "data"])

    return run


def _survive(rows: pd.DataFrame) -> pd.DataFrame:
    """For one block: its documents, their set sizes and fingerprints, and whether they can have a partner."""
    table = np.frombuffer(zstandard.decompress(rows.data[rows.kind == "table"].iloc[0]), np.int64).reshape(6, -1)
    shared = np.zeros(table.shape[1], np.int64)
    for blob in rows.data[rows.kind == "shared"]:
        who, n = np.frombuffer(blob, "<u4").reshape(2, -1)
        np.add.at(shared, who.astype(np.int64), n.astype(np.int64))
    ids, known, size, sampled, s1, s2 = table
    alive = (size > 0) & (known > 0) & (shared >= sampled - (size - -(-NUM * size // DEN)))
    names = pd.array(ids, "Int64")
    names[known == 0] = pd.NA
    return pd.DataFrame({"id": names, "n": size, "alive": alive, "s1": s1, "s2": s2})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in ts.chunks(*ts.utf8(batch.column(1))):
            sets = shingle_sets(data, offsets)
            n = np.array([len(s) for s in sets], np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            s1, s2 = fingerprints(sets)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            h = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), h], ["id", "n", "s1", "s2", "h"])


def prefixes(h: np.ndarray, n: np.ndarray, bits: int, often: np.ndarray) -> np.ndarray:
    """The prefixes of sets that lie in a row, n values each in ascending order: rare sampled hashes first, then the
    unsampled, then those in `often` (ascending), each by value.

    One search and one sort for all sets: a set costs its own size, however many hashes are frequent.
    """
    who = np.repeat(np.arange(len(n)), n)
    rank = np.ones(len(h), np.int64)
    sampled = np.flatnonzero(h >> np.uint64(63) == 0)
    rank[sampled] = 0
    if len(often):
        short = h[sampled] >> np.uint64(31 - bits)
        rank[sampled[often[np.minimum(np.searchsorted(often, short), len(often) - 1)] == short]] = 2
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    return h[np.argsort(who * 3 + rank, kind="stable")[place < prefix_length(n)[who]]]


def _keys(bits: int, limit: int, frequent):
    """List keys of each set: subsets of light sets, the prefix of heavy ones.  Kind 0: heavy list; else the smaller size of a light pair."""

    def some(ids: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        heavy = sizes > limit
        kept = sizes[heavy]
        lengths = prefix_length(kept)
        key, who = [prefixes(values[np.repeat(heavy, sizes)], kept, bits, frequent.value)], [np.repeat(ids[heavy], lengths)]
        size, kind = [np.repeat(kept, lengths)], [np.zeros(int(lengths.sum()), np.int32)]
        first = np.cumsum(sizes) - sizes
        for i in np.flatnonzero(-(-NUM * sizes // DEN) <= limit).tolist():
            for found, small in light_keys(values[first[i] : first[i] + sizes[i]], limit):
                key.append(found)
                who.append(np.full(len(found), ids[i]))
                size.append(np.full(len(found), sizes[i]))
                kind.append(np.full(len(found), small, np.int32))
        columns = [np.concatenate(key).view(np.int64), np.concatenate(who), np.concatenate(size).astype(np.int32), np.concatenate(kind)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "id", "n", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)).astype(np.int64)
            values = np.asarray(batch.column(2).flatten()).view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < len(ids):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + KEY_VALUES, "right")) - 1)
                yield some(ids[at:end], sizes[at:end], values[ends[at] : ends[end]])
                at = end

    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    a = sets.select(F.col("id").alias("u"), F.col("h").alias("hu"))
    b = sets.select(F.col("id").alias("v"), F.col("h").alias("hv"))
    both = pairs.join(b, "v").join(a, "u").select("u", "v", F.size(F.array_intersect("hu", "hv")).alias("i"), (F.size("hu") + F.size("hv")).alias("t"))
    return both.where(F.lit(DEN) * F.col("i") >= F.lit(NUM) * (F.col("t") - F.col("i"))).select("u", "v")


def _compatible(a: str, b: str) -> F.Column:
    return (F.lit(DEN) * F.least(a, b) >= F.lit(NUM) * F.greatest(a, b))


def _open_lists(keys: DataFrame, comp: DataFrame) -> DataFrame:
    """The heavy lists that hold several components, with the component (c) of each member."""
    held = keys.select("key", "id", "n", "kind").where("kind = 0").join(comp.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    mixed = held.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 != c2").select("key")
    return saved(held.join(mixed, "key").select("key", "id", "n", "kind", "c"), "lists")


def _stars(lists: DataFrame, turn: int) -> DataFrame:
    """Pairs (u, v): each list's centre with its other members.

    Light lists have their smallest set in the middle and count only if it has the smaller
    size of the pair; heavy lists the smallest id, from which copies tend to derive, and
    another member in later turns.
    """
    order = F.struct(F.when(F.col("kind") > 0, F.col("n")).otherwise(0).cast("long").alias("n"), "id") if not turn else F.struct(F.xxhash64("id", F.lit(turn)).alias("n"), "id")
    extra = [F.min_by("c", order).alias("cc")] if turn else []
    stars = lists.groupBy("kind", "key").agg(F.min(order).alias("m"), F.min_by("n", order).alias("cn"), F.count("*").alias("k"), *extra).where("k > 1")
    pairs = lists.join(stars, ["kind", "key"]).where("id != m.id and (kind = 0 or kind = cn)").where(_compatible("n", "cn"))
    if turn:
        pairs = pairs.where("c != cc")
    return pairs.select(F.greatest("id", F.col("m.id")).alias("u"), F.least("id", F.col("m.id")).alias("v")).distinct()


def _with_room(listed: DataFrame) -> DataFrame:
    """The rows (id, n, size, c1, c2, p, t) of classes on lists that can have a partner of another component on the same list.

    A set of n hashes, size of them left, has room for partners of up to (NUM + DEN) * size / NUM - n hashes, and its
    partner must have room for it; so per list the smallest set and the most room among other components decide.
    Without this a group of near copies meets all of itself on each of its hashes.
    """
    room = F.lit(NUM + DEN) * F.col("size") - F.lit(NUM) * F.col("n")
    # a class of several components is one of its own
    rows = listed.withColumn("lab", F.struct(F.expr("c1 = c2").alias("one"), F.expr("if(c1 = c2, c1, id)").alias("who"))).withColumn("room", room)
    labs = rows.groupBy("t", "lab").agg(F.min("n").alias("low"), F.max("room").alias("most"))
    best = labs.groupBy("t").agg(F.min(F.struct("low", "lab")).alias("x"), F.max(F.struct("most", "lab")).alias("y"), F.count("*").alias("k")).where("k > 1").drop("k")
    other = labs.join(best, "t").groupBy("t").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.min(F.expr("if(lab = x.lab, null, low)")).alias("low"), F.max(F.expr("if(lab = y.lab, null, most)")).alias("most"))
    bounds = rows.join(other, "t").where(F.lit(NUM) * F.expr("if(lab = x.lab, low, x.low)") <= F.col("room")).where(F.lit(NUM) * F.col("n") <= F.expr("if(lab = y.lab, most, y.most)"))
    return bounds.select(*listed.columns)


def _send_open(bits: int):
    """Blocks of (id, n, c, h) rows as sorted hashes by range, each with its set and component, and each block's table of sets."""

    def block(name: str, held: list[np.ndarray], flat: np.ndarray) -> Iterator[tuple[int, str, str, bytes]]:
        table = np.concatenate(held, axis=1)
        who = np.repeat(np.arange(table.shape[1], dtype=np.uint16), table[1])
        order = np.argsort(flat)
        flat, who = flat[order], who[order]
        bucket = (flat >> np.uint64(64 - bits)).astype(np.int64)
        edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
        for a, b in itertools.pairwise(edge.tolist()):
            data = flat[a:b].tobytes() + table[2][who[a:b]].tobytes() + who[a:b].tobytes()
            yield int(bucket[a]), name, "hashes", zstandard.compress(data, 1)
        at = int(ts.mix(np.array([hash_name(name)], np.uint64))[0] >> np.uint64(64 - bits))
        yield at, name, "table", zstandard.compress(table.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        flat: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal serial, held, flat
            rows = list(block(f"{part}-{serial}", held, np.concatenate(flat)))
            serial, held, flat = serial + 1, [], []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.string(), pa.binary()), strict=True)], ["bucket", "block", "kind", "data"])

        for batch in batches:
            table = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)])
            values = np.asarray(batch.column(3).flatten()).view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(table[1])])
            at = 0
            while at < table.shape[1]:
                end = min(at + BLOCK_DOCS // 2, max(at + 1, int(np.searchsorted(ends, ends[at] + OPEN_VALUES, "right")) - 1))
                held.append(table[:, at:end])
                flat.append(values[ends[at] : ends[end]].copy())
                at = end
                if sum(map(len, flat)) >= OPEN_VALUES or sum(x.shape[1] for x in held) >= BLOCK_DOCS // 2:
                    yield flush()
        if held:
            yield flush()

    return run


def _mark_open(rows: pd.DataFrame) -> pd.DataFrame:
    """For one range: the hashes of several components, by block, with the number of sets that have them."""
    out = [(r.block, "table", r.data) for r in rows.itertuples() if r.kind == "table"]
    sent = rows[rows.kind == "hashes"]
    raw = [zstandard.decompress(x) for x in sent.data]
    if raw:
        size = [len(x) // 18 for x in raw]
        t = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(raw, size, strict=True)])
        c = np.concatenate([np.frombuffer(x, np.int64, n, 8 * n) for x, n in zip(raw, size, strict=True)])
        order = np.argsort(t)
        ranked, c = t[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        times = np.diff(first, append=len(ranked))
        several = np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
        df = np.zeros(len(t), np.uint32)
        df[order] = np.repeat(np.where(several, times, 0), times)
        at = 0
        for name, x, n in zip(sent.block, raw, size, strict=True):
            some = np.flatnonzero(df[at : at + n])
            if len(some):
                who = np.frombuffer(x, np.uint16, n, 16 * n)
                out.append((name, "core", zstandard.compress(t[at : at + n][some].tobytes() + df[at : at + n][some].tobytes() + who[some].tobytes(), 1)))
            at += n
    return pd.DataFrame(out, columns=["block", "kind", "data"])


def _gather_open(rows: pd.DataFrame) -> pd.DataFrame:
    """For one block: the sets whose cores are large enough for a link, with their core's hashes, rarest first."""
    ids, n, c = np.frombuffer(zstandard.decompress(rows.data[rows.kind == "table"].iloc[0]), np.int64).reshape(3, -1)
    raw = [zstandard.decompress(x) for x in rows.data[rows.kind == "core"]]
    size = [len(x) // 14 for x in raw]
    t = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64, k) for x, k in zip(raw, size, strict=True))])
    df = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32, k, 8 * k) for x, k in zip(raw, size, strict=True))])
    who = np.concatenate([np.zeros(0, np.uint16), *(np.frombuffer(x, np.uint16, k, 12 * k) for x, k in zip(raw, size, strict=True))])
    t = t[np.lexsort((t, df, who))]
    held = np.bincount(who, minlength=len(ids))
    ends = np.cumsum(held)
    kept = np.flatnonzero((held > 0) & (DEN * held >= NUM * n))
    return pd.DataFrame({"id": ids[kept], "n": n[kept].astype(np.int32), "c": c[kept], "g": [t[ends[i] - held[i] : ends[i]] for i in kept.tolist()]})


def _cores(rows: DataFrame) -> DataFrame:
    """Of open sets (id, n, c, h), those with a core of at least NUM / DEN, and it (g): hashes that several components have, rarest first."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits = min(max(6, (total // OPEN_VALUES).bit_length()), 14)
    marked = rows.mapInArrow(tidy(_send_open(bits)), _SENT).groupBy("bucket").applyInPandas(tidy_group(_mark_open), "block string, kind string, data binary")
    return marked.groupBy("block").applyInPandas(tidy_group(_gather_open), "id bigint, n int, c bigint, g array<bigint>")


def _cross_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join all components which any links across them would join.

    For sets in different components only hashes that occur in several components can be
    common: the core of a set.  Sets with equal cores form a class, whatever else they
    hold.  With o common core hashes, sets of a and b hashes are linked iff
    NUM * (a + b) <= (NUM + DEN) * o, so in a class only size matters and its smallest set stands for
    it: two classes are linked iff their smallest sets are, and a member is linked to
    something iff it is linked to the smallest set of the partner that leaves most room
    (its own class among the partners).  A hot passage with different words around it is
    one class; pairs are formed of classes only.
    """
    who = saved(lists.select("id", "c").distinct(), "open")
    core = _cores(sets.join(F.broadcast(who) if who.count() <= BROADCAST_IDS else who, "id").select("id", "n", "c", "h"))
    core = saved(core.select("*", F.xxhash64("g").alias("k1"), F.xxhash64(F.lit(1), "g").alias("k2"), F.size("g").alias("size")), "cores")
    cls = core.groupBy("k1", "k2", "size").agg(F.min(F.struct("n", "id")).alias("m"), F.min("c").alias("c1"), F.max("c").alias("c2"), F.min_by("g", F.struct("n", "id")).alias("g"))
    cls = saved(cls.select("k1", "k2", "size", F.col("m.id").alias("id"), F.col("m.n").alias("n"), "c1", "c2", "g"), "classes")
    need = F.ceil(F.lit(NUM) * F.col("n") / F.lit(DEN)).cast("int")
    listed = cls.select("id", "n", "size", "c1", "c2", F.posexplode(F.slice("g", F.lit(1), F.col("size") - need + 1)).alias("p", "t")).withColumn("size", F.col("size") - F.col("p"))
    listed = saved(_with_room(listed), "roomy")
    a, b = (listed.select("t", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "size", "c1", "c2"))) for x in "ab")
    # At the first common hash of a pair only it and what follows can be common; the row of that hash is enough.
    room = (F.lit(NUM + DEN) * F.least("size_a", "size_b") >= F.lit(NUM) * (F.col("n_a") + F.col("n_b"))) & _compatible("n_a", "n_b")
    pairs = a.join(b, "t").where("id_a > id_b and not (c1_a = c2_a and c1_b = c2_b and c1_a = c1_b)").where(room).select("id_a", "n_a", "id_b", "n_b").distinct()
    pairs = saved(pairs, "class-pairs")
    ga, gb = (cls.select(F.col("id").alias(f"id_{x}"), F.col("g").alias(f"g_{x}")) for x in "ab")
    both = pairs.join(gb, "id_b").join(ga, "id_a").select("id_a", "n_a", "id_b", "n_b", F.size(F.array_intersect("g_a", "g_b")).alias("o"))
    linked = saved(both.where(F.lit(NUM + DEN) * F.col("o") >= F.lit(NUM) * (F.col("n_a") + F.col("n_b"))), "class-links")
    left = lambda x, y: linked.select(F.col(f"id_{x}").alias("cls"), F.col(f"id_{y}").alias("to"), (F.lit(NUM + DEN) * F.col("o") - F.lit(NUM) * F.col(f"n_{y}")).alias("left"))
    own = cls.select(F.col("id").alias("cls"), F.col("id").alias("to"), (F.lit(NUM + DEN) * F.col("size") - F.lit(NUM) * F.col("n")).alias("left"))
    best = left("a", "b").union(left("b", "a")).union(own).groupBy("cls").agg(F.max_by("to", F.struct("left", "to")).alias("to"), F.max("left").alias("left"))
    member = core.join(cls.select("k1", "k2", "size", F.col("id").alias("cls")), ["k1", "k2", "size"]).join(best, "cls").where(F.lit(NUM) * F.col("n") <= F.col("left")).where("id != to")
    out = member.select(F.greatest("id", "to").alias("u"), F.least("id", "to").alias("v")).union(linked.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))
    return saved(out.distinct(), "links")


def _links(keys: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, components) of all sets: rounds of verified stars, then what may still link across components."""
    links = comp = None
    lists = keys
    for turn in range(STAR_ROUNDS):
        # components only grow, so a list that is closed stays so
        lists = keys if not turn else _open_lists(lists, comp)
        pairs = saved(_stars(lists, turn), "pairs")
        new = saved(_verified(pairs, sets), "links")
        if turn and new.isEmpty():
            break
        links = new if links is None else links.union(new)
        comp = components(links)
    else:
        lists = _open_lists(lists, comp)
    if not lists.isEmpty():
        links = links.union(_cross_links(lists, sets))
        comp = components(links)
    return links, comp


def join_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, component_id) for each row of docs, and the verified links (u, v) between class representatives."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    size = plan_bytes(docs)
    bits = min(max(6, (size // RANGE_BYTES).bit_length()), 14)
    answers = saved(rows.mapInArrow(tidy(_send(bits)), _SENT).groupBy("bucket").applyInPandas(tidy_group(_answer(bits)), "block string, kind string, data binary"), "ranges")
    told = saved(answers.where("kind in ('table', 'shared')").groupBy("block").applyInPandas(_survive, "id bigint, n bigint, alive boolean, s1 bigint, s2 bigint"), "sizes")
    facts = answers.where("kind in ('frequent', 'lists')").select("kind", "data").collect()
    often = np.concatenate([np.zeros((2, 0), np.uint64), *(np.frombuffer(r.data, np.uint64).reshape(2, -1) for r in facts if r.kind == "frequent")], axis=1)
    often = often[0][np.argsort(often[1], kind="stable")[::-1][:MAX_FREQUENT]]
    lists = sum((np.frombuffer(r.data, np.int64) for r in facts if r.kind == "lists"), np.zeros(2, np.int64))
    limit = light_limit(lists[0] / max(lists[1], 1))

    alive = told.where("alive").select("id", "n", "s1", "s2")
    classes = alive.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    member = saved(alive.join(classes, ["n", "s1", "s2"]).select("id", "rep").distinct(), "classes")
    chosen = member.where("id = rep").select("id")
    reps = saved(only_ids(rows, chosen, "id").mapInArrow(tidy(_sets), "id bigint, n int, s1 bigint, s2 bigint, h array<bigint>"), "sets")
    if reps.count() > chosen.count():  # ids repeat
        reps = saved(reps.dropDuplicates(["id", "n", "s1", "s2"]), "reps")
    reps = reps.select("id", "n", "h")
    keys = saved(reps.mapInArrow(tidy(_keys(bits, limit, spark.sparkContext.broadcast(np.sort(often)))), "key bigint, id bigint, n int, kind int"), "keys")
    links, comp = _links(keys, reps)
    linked = member.where("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    # a copy's representative may itself point at a component
    final = linked.join(comp.select(F.col("node").alias("v"), "component"), "v", "left").select(F.col("u").alias("id"), F.coalesce("component", "v").alias("component"))
    final = final.union(comp.select(F.col("node").alias("id"), "component")).groupBy("id").agg(F.min("component").alias("component"))
    out = told.join(final, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out, links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that are linked to a smaller id: one row of each group stays, all columns."""
    out, _ = join_documents(docs, id_col, text_col)
    gone = saved(out.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "gone")
    return without_ids(docs, gone, id_col)
