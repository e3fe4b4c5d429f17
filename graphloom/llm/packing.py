"""Cost-balanced packing of token ids into sequences.

A sequence costs LINEAR * tokens + QUADRATIC * sum of squared piece lengths, as
attention runs within pieces.  Each task encodes its documents and packs them window
by window: documents go, longest first, to the cheapest sequence that still has room;
what fits nowhere whole is cut into the room that is left, cheapest sequence first, so
sequences are full.  What a window has over is carried into the next one, and the last
rest becomes sequences of a power of two of tokens; nothing is padded and nothing is
shuffled, so a lost task is simply run again.

Defined results: null and empty texts are one end id; null ids keep their pieces;
rows that repeat an id are packed each for itself; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encode_column
from .workers import tidy

CAPACITY = 4096
END_ID = 2
WINDOW_TOKENS = 2 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

#: (document, first id, length) of a piece.
Piece = tuple[int, int, int]


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack(lengths: list[Piece], capacity: int = CAPACITY) -> tuple[list[list[Piece]], list[Piece]]:
    """(full sequences, pieces left over: less than one sequence of tokens)."""
    full, items = [], []
    for doc, start, length in lengths:
        while length >= capacity:
            full.append([(doc, start, capacity)])
            start, length = start + capacity, length - capacity
        if length:
            items.append((doc, start, length))
    items.sort(key=lambda p: (-p[2], p[0], p[1]))
    n = sum(p[2] for p in items) // capacity
    made: list[list[Piece]] = [[] for _ in range(n)]
    room, price = np.full(n, capacity), np.zeros(n)

    def put(at: int, piece: Piece) -> None:
        made[at].append(piece)
        room[at] -= piece[2]
        price[at] += cost(piece[2])

    rest = []
    for piece in items:
        at = int(np.argmin(np.where(room >= piece[2], price, np.inf))) if n else 0
        if n and room[at] >= piece[2]:
            put(at, piece)
        else:
            rest.append(piece)
    rest.reverse()  # the longest is taken first, from the end
    for at in sorted(range(n), key=lambda i: (price[i], i)):
        while room[at]:
            doc, start, length = rest.pop()
            cut = min(length, int(room[at]))
            put(at, (doc, start, cut))
            if cut < length:
                rest.append((doc, start + cut, length - cut))
    return full + made, rest


def close(rest: list[Piece]) -> list[list[Piece]]:
    """The last pieces as sequences that hold a power of two of tokens each."""
    made, left = [], sum(p[2] for p in rest)
    rest = sorted(rest, key=lambda p: (p[2], -p[0], -p[1]))
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        made.append([])
        while room:
            doc, start, length = rest.pop()
            cut = min(length, room)
            made[-1].append((doc, start, cut))
            room -= cut
            if cut < length:
                rest.append((doc, start + cut, length - cut))
    return made


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[object, np.ndarray]] = {}
        pieces: list[Piece] = []
        tokens = serial = 0

        def emit(made: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for seq in made:
                at = 0
                for doc, start, length in seq:
                    name, ids = held[doc]
                    rows.append((name, start, length, zlib.crc32(ids[start : start + length]), len(ids), sequence, at))
                    at += length
                sequence += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

        id_type = pa.null()
        for batch in batches:
            id_type = batch.column(0).type
            for name, ids in zip(batch.column(0).to_pylist(), encode_column(batch.column(1), tokenizer, end_id), strict=True):
                held[serial] = name, ids
                pieces.append((serial, 0, len(ids)))
                serial, tokens = serial + 1, tokens + len(ids)
                if tokens >= WINDOW_TOKENS:
                    made, pieces = pack(pieces, capacity)
                    yield emit(made)
                    held = {p[0]: held[p[0]] for p in pieces}
                    tokens = sum(p[2] for p in pieces)
        if pieces:
            made, rest = pack(pieces, capacity)
            yield emit(made + close(rest))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"
    return rows.mapInArrow(tidy(run, encodes=True), schema).withColumnRenamed("id", id_col)
