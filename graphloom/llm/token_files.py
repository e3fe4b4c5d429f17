"""Token ids in binary shards with a shared zstandard dictionary.

A shard holds documents in ascending id order: a header (magic, width of an id, SHA-256
of the dictionary), one zstandard frame for each document, then the index (document
ids, frame offsets, id counts) and a trailer that says where the index starts.  A
reader opens the trailer and index first and can fetch any short document with one
small read; the dictionary's hash must match.  The manifest gives each shard the
number of ids before it, so global positions need no pass over the data.

Shards are ranges of document ids, so the ascending order is global.  A task writes
each shard under a name of its own attempt; only the manifest names those that count,
so a lost executor or a second attempt leaves nothing wrong behind.

Defined results: null and empty texts are one end id; rows that repeat an id follow
each other; null ids come first; an empty table gives no shards and an empty result;
with too few documents to train on, the dictionary is empty.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import file_system, plan_bytes, sample_by_hash, saved, shared_dir, spread
from .tokens import encode_column, encode_texts, encoder

MAGIC = b"TOKIDS01"
_HEAD, _TAIL = struct.Struct("<8sB32s"), struct.Struct("<QQ8s")
END_ID = 0
#: Documents that the dictionary is trained on (those with the smallest id hashes), its bytes, and input bytes for a shard.
TRAIN_DOCS, DICT_BYTES, SHARD_BYTES, MIN_SHARDS = 1000, 64 << 10, 16 << 20, 16


def ids_of(texts: list[str | None], tokenizer: str, end_id: int = END_ID) -> list[np.ndarray]:
    return encode_texts(texts, tokenizer, end_id)


def train_dictionary(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, n_docs: int = TRAIN_DOCS, size: int = DICT_BYTES, width: int = 2) -> bytes:
    """A dictionary from the ids of a bounded, repeatable sample of documents."""
    rows = sorted(sample_by_hash(docs, id_col, n_docs).select(F.col(text_col).cast("string").alias("t")).where("t != ''").collect())
    samples = [x.astype(f"<u{width}").tobytes() for x in ids_of([r[0] for r in rows], tokenizer)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    held = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    kw = {"dict_data": held} if held else {}
    return zstandard.ZstdCompressor(level=3, write_dict_id=False, **kw), zstandard.ZstdDecompressor(**kw)


class ShardWriter:
    """Frames go to the file as they come; only the index is held."""

    def __init__(self, uri: str, dictionary: bytes, width: int):
        fs, path = file_system(uri)
        self.out = fs.open_output_stream(path, compression=None)
        self.out.write(_HEAD.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))
        self.at = _HEAD.size
        self.ids: list[int | None] = []
        self.offsets, self.counts = [self.at], []

    def add(self, doc_id: int | None, frame: bytes, count: int) -> None:
        self.out.write(frame)
        self.at += len(frame)
        self.ids.append(doc_id)
        self.offsets.append(self.at)
        self.counts.append(count)

    def close(self) -> tuple[int, int]:
        known = np.array([i is not None for i in self.ids], "u1")
        for part in (np.array([i or 0 for i in self.ids], "<i8"), known, np.array(self.offsets, "<u8"), np.array(self.counts, "<u4")):
            self.out.write(part.tobytes())
        self.out.write(_TAIL.pack(self.at, len(self.ids), MAGIC))
        self.out.close()
        return len(self.ids), sum(self.counts)


class Shard:
    """Opens a shard by its index; `ids(i)` reads and decompresses one document."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index, n, magic = _TAIL.unpack(self.file.read_at(_TAIL.size, size - _TAIL.size))
        head, self.width, digest = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri} was written with another dictionary")
        raw = self.file.read_at(size - _TAIL.size - index, index)
        ids, known = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, 8 * n)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64)
        self.counts = np.frombuffer(raw, "<u4", n, 17 * n + 8).astype(np.int64)
        self._codec = _codec(dictionary)[1]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _decode(self, frame: bytes, count: int) -> np.ndarray:
        return np.frombuffer(self._codec.decompress(frame, max_output_size=count * self.width), f"<u{self.width}").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        a, b = self.offsets[i], self.offsets[i + 1]
        return self._decode(self.file.read_at(int(b - a), int(a)), int(self.counts[i]))

    def scan(self, step: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """All documents in order, in reads of about `step` bytes."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + step, "right")) - 1)
            base = self.offsets[i]
            raw = self.file.read_at(int(self.offsets[j] - base), int(base))
            for k in range(i, j):
                yield k, self._decode(raw[self.offsets[k] - base : self.offsets[k + 1] - base], int(self.counts[k]))
            i = j


def _cuts(docs: DataFrame, id_col: str, shards: int) -> list[int]:
    """Upper ends of id ranges with about equal row counts."""
    at = docs.agg(F.percentile_approx(F.col(id_col).cast("bigint"), [i / shards for i in range(1, shards)], 10_000)).first()[0] if shards > 1 else None
    return sorted(set(at or []))


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, width: int = 2, root: str | None = None) -> tuple[list[tuple[str, int, int, int]], bytes]:
    """Writes all documents; the manifest [(file, documents, ids, ids before it)] in order, and the dictionary."""
    spark = docs.sparkSession
    if max(encoder(tokenizer).top, end_id) >= 1 << 8 * width:
        raise ValueError(f"{tokenizer} has ids that do not fit {width} bytes")
    root = root or shared_dir(spark, "tokens")
    fs, path = file_system(root)
    fs.create_dir(path, recursive=True)
    dictionary = train_dictionary(docs, tokenizer, id_col, text_col, width=width)
    cuts = _cuts(docs, id_col, min(max(MIN_SHARDS, plan_bytes(docs) // SHARD_BYTES), 100_000))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(dictionary)[0]
        for batch in batches:
            names, counts, frames = batch.column(0).to_pylist(), [], []
            for ids in encode_column(batch.column(1), tokenizer, end_id):
                counts.append(len(ids))
                frames.append(codec.compress(ids.astype(f"<u{width}").tobytes()))
            shards = [0 if x is None else bisect_right(cuts, x) for x in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shards, pa.int32()), pa.array(counts, pa.int64()), pa.array(frames, pa.binary())], ["id", "shard", "n", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, done = None, None, []

        def close() -> None:
            done.append((uri, now, *out.close()))

        for batch in batches:
            for doc_id, shard, n, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != now:
                    if out:
                        close()
                    uri, now = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.tok", shard
                    out = ShardWriter(uri, dictionary, width)
                out.add(doc_id, frame, n)
        if out:
            close()
        columns = list(zip(*done, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["file", "shard", "docs", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    frames = rows.mapInArrow(encode, "id bigint, shard int, n bigint, frame binary")
    placed = frames.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions(F.col("shard"), F.col("id").asc_nulls_first(), F.col("n"), F.xxhash64("frame"))
    written = saved(placed.mapInArrow(write, "file string, shard int, docs bigint, ids bigint"), "manifest").orderBy("shard").collect()
    manifest, before = [], 0
    for r in written:
        manifest.append((r["file"], r["docs"], r["ids"], before))
        before += r["ids"]
    return manifest, dictionary


def read_shards(spark: SparkSession, manifest: list[tuple[str, int, int, int]], dictionary: bytes) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri, dictionary)
                crc = [zlib.crc32(ids.tobytes()) for _, ids in shard.scan()]
                starts = start + np.concatenate([[0], np.cumsum(shard.counts)])[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts.astype(np.int64)), pa.array(shard.counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if not manifest:
        return spark.createDataFrame([], schema)
    return spread(spark, [(f, b) for f, _, _, b in manifest], "file string, start bigint", 10_000).mapInArrow(read, schema)
