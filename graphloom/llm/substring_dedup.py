"""Exact removal of repeated substrings by external induced sorting of suffixes.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a
smaller id.  As in induced suffix sorting, few positions are sorted first and carry
all others:

1. Documents are written as shards to the shared folder.  Every LENGTH-byte string of a
   document is assigned its anchor, the leftmost smallest GRAM-byte hash in it; equal
   strings have equal anchors at equal distance.  Shards send their packed anchor hashes
   by hash range; each range answers which occur in two documents.  Only strings at
   such anchors can repeat, the rest of the corpus is settled.
2. A shard sends the text around its shared anchors to the range of the anchor, equal
   contexts of the shard once, with their smallest document.
3. A range sorts the suffixes that start at anchors with their common prefixes, and
   induces those that start 1, 2, ... bytes further left: tuples leave one byte-keyed
   queue in the order of the suffixes to their right and enter the next one, where a
   common prefix grows by one or is the minimum of those passed over.  Neighbours with
   LENGTH bytes in common are equal strings; the smallest document of each goes back.
   Anchors with more contexts than fit in memory go through a disk-backed priority
   queue of suffix tuples instead: sorted runs on disk, merged block by block.
4. Each shard unites the answers of all ranges and cuts its documents.

Text is shuffled only around shared anchors; a passage that a third of all documents
hold is one context per shard.

Defined results: null and empty texts have nothing to remove; texts of fewer than LENGTH
bytes stay whole; rows that repeat an id do not remove each other; a row with a null id
stays whole and removes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .store import file_system, plan_bytes, saved, shared_dir

LENGTH, GRAM = 50, 24
GRAMS = LENGTH - GRAM + 1
SHARD_TEXT, RANGE_BYTES = 3 << 20, 2 << 20
CHUNK = 256 << 10
#: Contexts of one anchor, or of the anchors sorted together, that are held in memory.
MEMORY_ROWS = 200_000

_BYTES = ts.byte_weights(False)
_NEVER = np.iinfo(np.int64).max


# --- anchors -------------------------------------------------------------------------------------------------------


def _grams(data: np.ndarray) -> np.ndarray:
    at = np.arange(len(data) - GRAM + 1)
    return ts.span_hashes(data, at, at + GRAM, _BYTES)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string start, number of strings, anchor position, anchor hash) of each run of strings with one anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, np.zeros(0, np.uint64)
    low = _grams(data)
    hashes = low
    at = np.arange(len(low), dtype=np.int32)
    width = 1
    while width < GRAMS:
        step = min(width, GRAMS - width)
        less = low[step:] < low[: len(low) - step]
        at = np.where(less, at[step:], at[: len(at) - step])
        low = np.minimum(low[step:], low[: len(low) - step])
        width += step
    ok = np.ones(len(at), bool)
    for a, b in itertools.pairwise(offsets.tolist()):
        ok[max(a, b - LENGTH + 1) : b] = False
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64)
    p = at[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    # Smallest hashes crowd at the low end; mixed once more they fill all ranges alike.
    return starts[first], np.diff(first, append=len(starts)), p[first], ts.mix(hashes[p[first]])


class Shard:
    """Some documents: their bytes, offsets, ids and which ids are known."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, known: np.ndarray):
        self.data, self.offsets, self.ids, self.known = data, offsets, ids, known

    def save(self, uri: str) -> None:
        fs, path = file_system(uri)
        head = np.array([len(self.ids)], "<i8").tobytes() + self.offsets.astype("<i8").tobytes() + self.ids.astype("<i8").tobytes() + self.known.astype("u1").tobytes()
        with fs.open_output_stream(path, compression=None) as out:
            out.write(zstandard.ZstdCompressor(level=1).compress(head + self.data.tobytes()))

    @classmethod
    def load(cls, uri: str) -> Shard:
        fs, path = file_system(uri)
        with fs.open_input_file(path) as f:
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read()), np.uint8)
        n = int(raw[:8].view("<i8")[0])
        cut = np.cumsum([8, 8 * (n + 1), 8 * n, n])
        return cls(raw[cut[3] :], raw[8 : cut[1]].view("<i8").astype(np.int64), raw[cut[1] : cut[2]].view("<i8").astype(np.int64), raw[cut[2] : cut[3]] > 0)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Anchors of all documents with an id, and the document of each."""
        parts = []
        for first, end, data, offsets in ts.chunks(self.data, self.offsets, CHUNK):
            start, n, p, h = anchors(data, offsets)
            base = self.offsets[first]
            doc = np.searchsorted(self.offsets[first : end + 1] - base, start, "right") - 1 + first
            keep = self.known[doc]
            parts.append([x[keep] for x in (start + base, n, p + base, h, doc)])
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _split(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash range, key in it)."""
    return (h >> np.uint64(64 - bits)).astype(np.int64), ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes by significance, compressed; the reader knows the types."""
    body = b"".join(np.array([len(a)], "<i8").tobytes() + np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), 0, []
    for kind in kinds:
        n, size = int(raw[at : at + 8].copy().view("<i8")[0]), np.dtype(kind).itemsize
        at += 8
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


# --- steps ---------------------------------------------------------------------------------------------------------


def _write_shards(root: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            data = np.concatenate([d for d, _, _ in held])
            sizes = np.concatenate([np.diff(o) for _, o, _ in held])
            names = [x for _, _, n in held for x in n]
            held.clear()
            shard = Shard(data, np.concatenate([[0], np.cumsum(sizes)]), np.array([x or 0 for x in names], np.int64), np.array([x is not None for x in names], bool))
            uri = f"{root}/shard-{uuid.uuid4().hex}"
            shard.save(uri)
            _, _, _, h, doc = shard.anchors()
            # Each hash once, with a mark if several ids of the shard have it.
            order = np.lexsort((shard.ids[doc], h))
            h, who = h[order], shard.ids[doc][order]
            new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            several = np.logical_or.reduceat(np.concatenate([[False], (who[1:] != who[:-1]) & ~new[1:]]), first) if len(h) else new
            bucket, key = _split(h[first], bits)
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
            rows = [(int(bucket[a]), uri, _pack(np.diff(key[a:b], prepend=np.uint32(0)).astype("<u4"), several[a:b].astype("u1"))) for a, b in itertools.pairwise(edge.tolist())]
            rows.append((int(bucket[0]) if len(bucket) else 0, uri, b""))  # so that a shard without shared anchors is not lost
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], ["bucket", "shard", "data"])

        for batch in batches:
            for first, end, data, offsets in ts.chunks(*ts.utf8(batch.column(1)), SHARD_TEXT // 4):
                held.append((data, offsets, batch.column(0).slice(first, end - first).to_pylist()))
                if sum(len(d) + len(n) for d, _, n in held) >= SHARD_TEXT:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _shared(rows: pd.DataFrame) -> pd.DataFrame:
    """For one hash range: for each shard, its hashes that two documents have."""
    sent = rows[rows.data.str.len() > 0]
    out = [(s, 0, b"") for s in rows.shard[rows.data.str.len() == 0]]
    got = [_unpack(x, "<u4", "u1") for x in sent.data]
    if got:
        got = [(np.cumsum(k, dtype=np.uint32), m) for k, m in got]
        key = np.concatenate([k for k, _ in got])
        where = np.repeat(np.arange(len(got)), [len(k) for k, _ in got])
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
        times = np.add.reduceat(1 + np.concatenate([m for _, m in got])[order].astype(np.int64), edge[:-1])
        good = np.zeros(len(key), bool)
        good[order] = np.repeat(times > 1, np.diff(edge))
        cut = np.searchsorted(where, np.arange(len(got) + 1))
        for i, name in enumerate(sent.shard):
            k = key[cut[i] : cut[i + 1]][good[cut[i] : cut[i + 1]]]
            if len(k):
                out.append((name, int(rows.bucket.iloc[0]), _pack(np.diff(k, prepend=np.uint32(0)).astype("<u4"))))
    return pd.DataFrame(out, columns=["shard", "bucket", "data"])


class Contexts:
    """The text around the shared anchors of a shard: each distinct one once."""

    def __init__(self, shard: Shard, shared: list[tuple[int, bytes]], bits: int):
        start, n, p, h, doc = shard.anchors()
        keys = np.sort(np.concatenate([np.cumsum(_unpack(b, "<u4")[0], dtype=np.uint32).astype(np.uint64) | np.uint64(at) << np.uint64(32) for at, b in shared] or [np.zeros(0, np.uint64)]))
        code = h >> np.uint64(32 - bits)
        keep = np.flatnonzero(np.isin(code, keys))
        self.start, self.n, self.doc = start[keep], n[keep], doc[keep]
        shift, code = (p - start)[keep], code[keep]
        size = self.n + LENGTH - 1
        same = ts.span_hashes(shard.data, self.start, self.start + size, _BYTES) if len(keep) else np.zeros(0, np.uint64)
        same = ts.mix(same + (shift << 8 | self.n).astype(np.uint64))
        # Entries in the order of their range, then of their context; `entry` tells which one an occurrence has.
        order = np.lexsort((shard.ids[self.doc], same, code))
        new = np.ones(len(order), bool)
        new[1:] = (same[order][1:] != same[order][:-1]) | (code[order][1:] != code[order][:-1])
        self.entry = np.zeros(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        lead = order[new]
        self.low = shard.ids[self.doc[lead]]  # smallest id: the first of its context
        self.bucket = (code[lead] >> np.uint64(32)).astype(np.int64)
        self.lead, self.shift, self.size, self.shard = lead, shift, size, shard

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """(range, packed contexts) for each range."""
        edge = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))
        for a, b in itertools.pairwise(edge.tolist()):
            lead = self.lead[a:b]
            text = b"".join([self.shard.data[s : s + z].tobytes() for s, z in zip(self.start[lead].tolist(), self.size[lead].tolist(), strict=True)])
            yield int(self.bucket[a]), _pack(self.n[lead].astype("u1"), self.shift[lead].astype("u1"), self.low[a:b].astype("<i8"), np.frombuffer(text, np.uint8))

    def first_entry(self) -> dict[int, int]:
        edge = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        return dict(zip(self.bucket[edge].tolist(), edge.tolist(), strict=True))


def _send_contexts(bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        uri = rows.shard.iloc[0]
        found = Contexts(Shard.load(uri), [(r.bucket, r.data) for r in rows.itertuples() if len(r.data)], bits)
        return pd.DataFrame([(at, uri, blob) for at, blob in found.messages()], columns=["bucket", "shard", "data"])

    return run


# --- induced sorting -----------------------------------------------------------------------------------------------


class DiskQueue:
    """A priority queue of (string, value, row) tuples on disk: pushes become sorted runs, pops merge them by blocks."""

    BLOCK = 4096

    def __init__(self, rows: int = MEMORY_ROWS):
        self.rows, self.held, self.n, self.runs = rows, [], 0, []
        self.folder = tempfile.TemporaryDirectory(prefix="queue-")

    def push(self, strings: np.ndarray, values: np.ndarray, rows: np.ndarray) -> None:
        block = np.empty(len(rows), [("s", strings.dtype), ("v", "<i8"), ("r", "<i8")])
        block["s"], block["v"], block["r"] = strings, values, rows
        self.held.append(block)
        self.n += len(block)
        if self.n >= self.rows:
            self._spill()

    def _spill(self) -> None:
        if self.n:
            block = np.concatenate(self.held)
            name = os.path.join(self.folder.name, f"{len(self.runs)}.npy")
            np.save(name, block[np.argsort(block["s"], kind="stable")])
            self.runs.append(name)
            self.held, self.n = [], 0

    def _run(self, name: str) -> Iterator[tuple]:
        block = np.load(name, mmap_mode="r")
        for at in range(0, len(block), self.BLOCK):
            yield from block[at : at + self.BLOCK].tolist()

    def classes(self) -> Iterator[tuple[int, list[int]]]:
        """(smallest value, rows) for each string, in order; a string's rows come in lists of BLOCK at most, twice read."""
        self._spill()
        for _, same in itertools.groupby(heapq.merge(*map(self._run, self.runs), key=lambda x: x[0]), key=lambda x: x[0]):
            low, rows = _NEVER, []
            for _, v, r in same:
                low = min(low, v)
                rows.append(r)
            yield low, rows


def induce(text: np.ndarray, start: np.ndarray, size: np.ndarray, shift: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each context and each distance from its anchor to the left: the smallest document with that string.

    Contexts lie in `text` at start, size bytes long, the anchor shift bytes in; strings
    start at the first n positions.  Columns are distances; _NEVER where there is no string.
    """
    rows = len(start)
    best = np.full((rows, GRAMS), _NEVER)
    if not rows:
        return best
    right = size - shift
    wide = np.zeros((rows, 56), np.uint8)  # 0 is the end of a context; UTF-8 leaves room for bytes one higher
    for j in range(int(right.max())):
        live = right > j
        wide[live, j] = text[start[live] + shift[live] + j] + 1
    parts = wide.view(">u8")
    rank = np.lexsort(parts.T[::-1])
    ranked, length = wide[rank], right[rank]
    differ = ranked[1:] != ranked[:-1]
    common = np.where(differ.any(1), differ.argmax(1), 56)
    common = np.concatenate([[0], np.minimum(common, np.minimum(length[1:], length[:-1]))])
    group = np.cumsum(common < GRAM)
    for j in range(GRAMS):
        if j:
            # The queue for distance j: keyed by the anchor and the byte to the left, first in first out.
            at = np.flatnonzero(shift[rank] >= j)
            key = group[at] << 8 | text[start[rank[at]] + shift[rank[at]] - j]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            grown = np.zeros(len(at), np.int64)
            pair = np.flatnonzero(key[1:] == key[:-1]) + 1
            if len(pair):
                # Minimum of the common prefixes passed over since the tuple before.
                ends = np.empty(2 * len(pair), np.int64)
                ends[0::2], ends[1::2] = at[pair - 1] + 1, at[pair] + 1
                padded = np.append(common, 0)
                grown[pair] = 1 + np.minimum.reduceat(padded, ends)[0::2]
            rank, common, group = rank[at], grown, group[at]
        if not len(rank):
            break
        own = shift[rank] - j < n[rank]
        edge = np.flatnonzero(common < LENGTH)
        lowest = np.minimum.reduceat(np.where(own, low[rank], _NEVER), edge)
        best[rank, j] = np.where(own, np.repeat(lowest, np.diff(edge, append=len(rank))), _NEVER)
    return best


def _on_disk(text: np.ndarray, start: np.ndarray, shift: np.ndarray, n: np.ndarray, low: np.ndarray, memory: int) -> np.ndarray:
    """As induce, for one anchor with too many contexts: suffix tuples of one distance at a time through a DiskQueue."""
    best = np.full((len(start), GRAMS), _NEVER)
    for j in range(GRAMS):
        queue = DiskQueue(memory)
        rows = np.flatnonzero((shift >= j) & (shift - j < n))
        for at in range(0, len(rows), memory // 4 + 1):
            some = rows[at : at + memory // 4 + 1]
            strings = text[(start[some] + shift[some] - j)[:, None] + np.arange(LENGTH)] + np.uint8(1)
            queue.push(np.ascontiguousarray(strings).view(f"S{LENGTH}").ravel(), low[some], some)
        for value, same in queue.classes():
            best[same, j] = value
    return best


def sort_range(text: np.ndarray, n: np.ndarray, shift: np.ndarray, low: np.ndarray, memory: int = MEMORY_ROWS) -> np.ndarray:
    """Smallest documents for all contexts of a range, some anchors at a time."""
    size = n + LENGTH - 1
    start = np.cumsum(size) - size
    anchor = ts.span_hashes(text, start + shift, start + shift + GRAM, _BYTES)
    order = np.argsort(anchor, kind="stable")
    best = np.full((len(n), GRAMS), _NEVER)
    edge = np.flatnonzero(np.diff(anchor[order], prepend=np.uint64(0)) != 0) if len(n) else np.zeros(0, np.int64)
    edge = np.unique(np.concatenate([[0], edge, [len(n)]]))
    at = 0
    while at < len(edge) - 1:
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + memory, "right")) - 1)
        some = order[edge[at] : edge[to]]
        if len(some) > memory:
            best[some] = _on_disk(text, start[some], shift[some], n[some], low[some], memory)
        else:
            best[some] = induce(text, start[some], size[some], shift[some], n[some], low[some])
        at = to
    return best


def _sort(rows: pd.DataFrame) -> pd.DataFrame:
    """One range: for each shard the runs of strings that a smaller document has: (entry, first string, strings, document)."""
    got = [_unpack(x, "u1", "u1", "<i8", "u1") for x in rows.data]
    n, shift, low, text = (np.concatenate([g[i] for g in got]) for i in range(4))
    n, shift = n.astype(np.int64), shift.astype(np.int64)
    best = sort_range(text, n, shift, low)
    out, at = [], 0
    for name, g in zip(rows.shard, got, strict=True):
        mine = slice(at, at + len(g[0]))
        at += len(g[0])
        b = best[mine]
        entry, j = np.nonzero(b < low[mine, None])
        if len(entry):
            string, doc = shift[mine][entry] - j, b[entry, j]
            order = np.lexsort((string, entry))
            entry, string, doc = entry[order], string[order], doc[order]
            new = np.ones(len(entry), bool)
            new[1:] = (entry[1:] != entry[:-1]) | (string[1:] != string[:-1] + 1) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            out.append((name, int(rows.bucket.iloc[0]), _pack(entry[first].astype("<u4"), string[first].astype("u1"), np.diff(first, append=len(entry)).astype("u1"), doc[first].astype("<i8"))))
    return pd.DataFrame(out, columns=["shard", "bucket", "data"])


def _cut(bits: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.load(rows.shard.iloc[0])
        found = Contexts(shard, [(r.bucket, r.data) for r in rows.itertuples() if r.kind == "shared" and len(r.data)], bits)
        gone = np.zeros(len(shard.data) + 1, np.int64)

        def cover(a: np.ndarray, strings: np.ndarray) -> None:
            np.add.at(gone, a, 1)
            np.add.at(gone, a + strings + LENGTH - 1, -1)

        # Within the shard: a context whose smallest document is another one covers all its strings.
        later = shard.ids[found.doc] > found.low[found.entry]
        cover(found.start[later], found.n[later])
        by = np.argsort(found.entry, kind="stable")
        ends = np.searchsorted(found.entry[by], np.arange(len(found.low) + 1))
        base = found.first_entry()
        for r in rows.itertuples():
            if r.kind == "answer":
                entry, string, count, doc = (x.astype(np.int64) for x in _unpack(r.data, "<u4", "u1", "u1", "<i8"))
                entry += base[r.bucket]
                times = ends[entry + 1] - ends[entry]
                each = np.repeat(np.arange(len(entry)), times)
                where = by[np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(ends[entry], times)]
                hit = shard.ids[found.doc[where]] > doc[each]
                cover((found.start[where] + string[each])[hit], count[each][hit])
        gone = np.cumsum(gone)[:-1] > 0
        out = []
        kept = ~gone
        _, _, first = ts.spans(gone, shard.offsets)
        spans = np.diff(first)
        for i, (a, b) in enumerate(itertools.pairwise(shard.offsets.tolist())):
            left = shard.data[a:b][kept[a:b]]
            out.append((int(shard.ids[i]) if shard.known[i] else None, b - a, b - a - len(left), int(spans[i]), hashlib.sha256(left.tobytes()).hexdigest()))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs."""
    spark = docs.sparkSession
    root = shared_dir(spark, "shards")
    fs, path = file_system(root)
    fs.create_dir(path, recursive=True)
    bits = min(max(6, (plan_bytes(docs) // RANGE_BYTES).bit_length()), 16)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    message = "bucket int, shard string, data binary"
    shared = saved(rows.mapInArrow(_write_shards(root, bits), message).groupBy("bucket").applyInPandas(_shared, "shard string, bucket int, data binary"), "anchors")
    sent = shared.groupBy("shard").applyInPandas(_send_contexts(bits), message)
    answers = sent.groupBy("bucket").applyInPandas(_sort, "shard string, bucket int, data binary")
    both = shared.withColumn("kind", F.lit("shared")).unionByName(answers.withColumn("kind", F.lit("answer")))
    out = both.groupBy("shard").applyInPandas(_cut(bits), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
