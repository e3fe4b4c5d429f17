"""Vectorised scanning of UTF-8 text held in Arrow buffers.

Everything works on one flat byte array and the offsets of its documents, so a
batch of documents costs a handful of numpy passes instead of a Python loop over
words.  Words never cross documents; a null text is an empty document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text that is scanned at once, but for a longer document.
CHUNK_BYTES = 512 << 10
#: Bytes for which word_hashes holds 64-bit sums at once, but for a longer word; beyond it powers aren't kept.
HASH_BYTES = 256 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE_INV = np.uint64(_inverse(int(_BASE)))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _grow(kind: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[kind]) >= n:
        return _powers[kind][:n]
    steps = np.full(n if n > 8 * HASH_BYTES else 1 << max(n - 1, 1).bit_length(), base, np.uint64)
    steps[0] = 1
    np.multiply.accumulate(steps, out=steps)
    if n <= 8 * HASH_BYTES:
        _powers[kind] = steps
    return steps[:n]


def byte_weights(fold_case: bool) -> np.ndarray:
    """A random 64-bit weight for each byte; with fold_case A-Z weigh as a-z."""
    weights = np.random.RandomState(20240131).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_case:
        weights[65:91] = weights[97:123]
    return weights


def byte_class(spans: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Bytes of words that end at white space: [^\x20\x09-\x0D].
SPACED = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of words made of digits, letters and everything beyond ASCII (upper case counts, it is folded before).
ALNUM = byte_class([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, bytes, offsets) with about `limit` bytes each and whole documents."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `mask` inside documents, and the first run of each document (n + 1)."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(mask)
    before[1:] = mask[:-1]
    before[0] = False
    cut = offsets[:-1]
    before[cut[cut < len(mask)]] = False
    after = np.empty_like(mask)
    after[:-1] = mask[1:]
    after[-1] = False
    cut = offsets[1:]
    after[cut[cut > 0] - 1] = False
    starts = np.flatnonzero(mask & ~before)
    return starts, np.flatnonzero(mask & ~after) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads a sum over all 64 bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one prefix sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(weights[data] * _grow("up", _BASE, len(data)), out=total[1:])
    down = _grow("down", _BASE_INV, len(data) + 1)
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weights: np.ndarray, limit: int = HASH_BYTES) -> np.ndarray:
    """As span_hashes, of ascending spans that don't overlap; the sums are held for `limit` bytes at once."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        base = starts[i]
        out[i:j] = span_hashes(data[base : ends[j - 1]], starts[i:j] - base, ends[i:j] - base, weights)
        i = j
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; only positions with k words left in the array."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n].copy()
    for j in range(1, k):
        total *= _STEP
        total += words[j : j + n]
    return mix(total)


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """For n = gram count of gram_hashes: whether the k words from a position lie in one document."""
    ok = np.ones(max(n, 0), bool)
    for j in range(1, k):
        cut = first[1:-1] - j
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def owners(first: np.ndarray) -> np.ndarray:
    """The document of each word, from the first word of each document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
