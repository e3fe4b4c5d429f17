"""Benchmark decontamination by winnowing.

A window is SPAN consecutive words of an item (lower-cased letters, digits and
non-ASCII characters); an item with fewer words is one window.  Both sides keep the
smallest K-gram hash of every SPAN - K + 1 successive K-grams, so any SPAN words that
two texts share have a fingerprint in common.  Document fingerprints are joined with
the item fingerprints, and each hit is extended word by word in both directions; a
span of SPAN words or more covers its words and names its item.  Items shorter than
SPAN words have no full winnowing window: their whole text is looked up by its own
length, which is exact as well.

The benchmark is the stated query set.  It goes to the executors in blocks of at most
BLOCK_BYTES of text (or one longer item).  One block, the usual case, is one pass without
a shuffle.  With more, each pass writes its rows with what it found so far, and the next
reads them; the broadcast of a pass is given up after it, so neither the driver nor a
worker ever holds more than one block, however large the benchmark grows.

Defined results: null or empty texts have no words, hit nothing and are hit by
nothing; without items nothing is hit; repeated rows are judged one by one; repeated
items all count; an item without an id is reported under no id but its windows hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from .workers import tidy
from pyspark.sql import functions as F

from . import textscan as ts
from .store import saved

SPAN = 10
K = 5
BLOCK_BYTES = 16 << 20

_FOLDED = ts.byte_weights(True)


def winnow(words: np.ndarray, first: np.ndarray, k: int = K, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): for every span of `span` words inside a document, its rightmost smallest k-gram."""
    grams = ts.gram_hashes(words, k)
    w = span - k + 1
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, at = grams[w - 1 : w - 1 + n].copy(), np.arange(w - 1, w - 1 + n)
    for j in range(w - 2, -1, -1):
        less = grams[j : j + n] < low
        low[less] = grams[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    at = at[ts.inside(first, span, n)]
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    at = at[keep]
    return at, grams[at]


@dataclass
class Items:
    """Fingerprints of a block of benchmark items."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    prints: np.ndarray  # sorted
    at: np.ndarray  # word positions, by print
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # length: sorted hashes, items


def build_items(ids: list, texts: list[str | None], span: int = SPAN, k: int = K) -> Items:
    data, offsets = ts.utf8(pa.array(texts, pa.large_string()))
    starts, ends, first = ts.spans(ts.ALNUM[data], offsets)
    words = ts.word_hashes(data, starts, ends, _FOLDED)
    at, prints = winnow(words, first, k, span)
    order = np.argsort(prints, kind="stable")
    short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    length = np.diff(first)
    for n in sorted({*length[(length > 0) & (length < span)].tolist()}):
        items = np.flatnonzero(length == n)
        hashes = ts.gram_hashes(words, n)[first[items]]
        by = np.argsort(hashes, kind="stable")
        short[n] = hashes[by], items[by]
    return Items(ids, words, first, ts.owners(first), prints[order], at[order], short)


def _pairs(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal values; `table` is sorted."""
    low, high = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
    n = high - low
    left = np.repeat(np.arange(len(keys)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _extend(words: np.ndarray, low: np.ndarray, high: np.ndarray, p: np.ndarray, items: Items, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that agree to the left of p and from p on; low and high bound p's document."""
    item = items.owner[q]
    reach = [np.minimum(p - low, q - items.first[item]), np.minimum(high - p, items.first[item + 1] - q)]
    out = []
    for side, room in zip((-1, 1), reach, strict=True):
        far = np.zeros(len(p), np.int64)
        live = np.flatnonzero(room > 0)
        while len(live):
            step = far[live] + 1 if side < 0 else -far[live]
            same = words[p[live] - step] == items.words[q[live] - step]
            live = live[same]
            far[live] += 1
            live = live[far[live] < room[live]]
        out.append(far)
    return out[0], out[1]


def hits(data: np.ndarray, offsets: np.ndarray, items: Items, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each document (n + 1), whether each word is hit, distinct pairs of document and item)."""
    starts, ends, first = ts.spans(ts.ALNUM[data], offsets)
    words = ts.word_hashes(data, starts, ends, _FOLDED)
    owner = ts.owners(first)
    cover = np.zeros(len(words) + 1, np.int64)
    found = []
    at, prints = winnow(words, first, k, span)
    seed, hit = _pairs(prints, items.prints)
    if len(seed):
        p, q = at[seed], items.at[hit]
        doc = owner[p]
        left, right = _extend(words, first[doc], first[doc + 1], p, items, q)
        good = left + right >= span
        np.add.at(cover, (p - left)[good], 1)
        np.add.at(cover, (p + right)[good], -1)
        found.append(np.stack([doc[good], items.owner[q[good]]], 1))
    for n, (hashes, which) in items.short.items():
        grams = ts.gram_hashes(words, n)
        pos = np.flatnonzero(ts.inside(first, n, len(grams)) & np.isin(grams, hashes))
        a, b = _pairs(grams[pos], hashes)
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + n, -1)
        found.append(np.stack([owner[pos[a]], which[b]], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return first, np.cumsum(cover)[:-1] > 0, pairs


def _in_documents(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many words of each document are marked."""
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[first[1:]] - total[first[:-1]]


def item_digest(ids: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[list, list]]:
    """The query set in blocks of bounded text, read through the driver one partition at a time; one block at least."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col).cast("string")).toLocalIterator():
        more = len((row[1] or "").encode())
        if size and size + more > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += more
    yield ids, texts


def _passes(blocks: Iterator[tuple[list, list]]) -> Iterator[tuple[Items, bool]]:
    """(fingerprints of a block, whether it is the last)."""
    held = next(blocks)
    for block in blocks:
        yield build_items(*held), False
        held = block
    yield build_items(*held), True


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    Between passes a row carries its hit words as bits and the names of its items.
    """
    context = docs.sparkSession.sparkContext
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("names"))
    state = f"id {kind}, t string, hit binary, names array<string>"
    result = f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    for items, last in _passes(item_blocks(benchmark, item_id, item_text, block_bytes)):
        block = context.broadcast(items)
        rows = rows.mapInArrow(_judge(block, last), result if last else state)
        if not last:
            rows = saved(rows, "decontaminate")
            block.destroy()
    return rows.withColumnRenamed("id", id_col)


def _judge(block: Broadcast, last: bool):
    """One pass of `mark`: the rows with what this block adds or, after the last one, the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in ts.chunks(*ts.utf8(batch.column(1))):
                part = batch.slice(start, end - start)
                first, hit, pairs = hits(data, offsets, block.value)
                names = [x or [] for x in part.column(3).to_pylist()]
                for d, i in pairs.tolist():
                    if block.value.ids[i] is not None:
                        names[d].append(str(block.value.ids[i]))
                for d, bits in enumerate(part.column(2)):
                    if bits.is_valid:
                        mine = slice(first[d], first[d + 1])
                        hit[mine] |= np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=first[d + 1] - first[d]).astype(bool)
                n_hit = _in_documents(hit, first)
                if last:
                    columns = [pa.array(np.diff(first)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in names], pa.int64()), pa.array([item_digest(x) for x in names], pa.string()), pa.array(n_hit > 0)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
                else:
                    bits = [np.packbits(hit[a:b]).tobytes() if n else None for a, b, n in zip(first[:-1], first[1:], n_hit, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))], ["id", "t", "hit", "names"])

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, all columns, no shuffle."""
    at = docs.columns.index(text_col)

    def keep(block: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for start, end, data, offsets in ts.chunks(*ts.utf8(batch.column(at))):
                    first, hit, _ = hits(data, offsets, block.value)
                    clean[start:end] = _in_documents(hit, first) == 0
                yield batch.filter(pa.array(clean))

        return run

    schema = docs.schema
    for items, last in _passes(item_blocks(benchmark, item_id, item_text, block_bytes)):
        block = docs.sparkSession.sparkContext.broadcast(items)
        docs = docs.mapInArrow(tidy(keep(block)), schema)
        if not last:
            docs = saved(docs, "decontaminate")
            block.destroy()
    return docs
