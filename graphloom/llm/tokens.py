"""Encoding whole texts with a public tokenizer, one distinct chunk at a time.

Both tokenizers split a text before merging: always at the start of white space that
follows something else, and always between a letter and an ASCII sign or digit after
it.  So a text is the sequence of such chunks, and the ids of a text are the ids of its
chunks in a row.  Words recur, so the library encodes each chunk once and a worker keeps
its ids in a table with open addressing: chunks of at most KEY_BYTES bytes are their own
key, as whole 8-byte words and a length, so nothing rests on a hash; longer ones are
encoded each time.  Chunks are cut, looked up and put together by numpy, STEP at a time.

New chunks are encoded many in one call; the byte lengths of the ids tell where each
chunk ends.  A chunk that is one word of Latin letters, the common case, is one unit of
the tokenizer's model; it goes to the library with the model alone, without the
pattern that would find that out again.  Others that start with white space are joined
to a text, and what is left is encoded chunk by chunk.  The table holds MAX_CHUNKS
chunks and is emptied when full, so memory is bounded.

The library takes the file's added tokens (such as `<|endoftext|>`) out of a text before
all else and encodes what lies between them apart; so each is a chunk of its own here.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from . import textscan as ts

KEY_WORDS, MAX_CHUNKS, STEP = 4, 1 << 19, 1 << 15
KEY_BYTES = 8 * KEY_WORDS
#: Text that is encoded together.
TEXT_BYTES = 1 << 20

_SPACE = ts.byte_class([(0x09, 0x0D), (0x20, 0x20)])
_ASCII_LETTER = ts.byte_class([(0x41, 0x5A), (0x61, 0x7A)])
_ASCII_SIGN = ~_SPACE & ~_ASCII_LETTER & ~ts.byte_class([(0x80, 0xFF)])
#: The last two or three bytes of white space beyond ASCII, as Unicode's White_Space property has it; fixed values.
_WIDE_SPACES = "\x85\xa0                　"
_WIDE = np.array(sorted(int.from_bytes(c.encode().rjust(3, b"\0"), "big") for c in _WIDE_SPACES), np.int64)
_ACCENTED = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: One word of the model, and chunks that can be encoded as part of a longer text: both keep their byte length when lower-cased.
_WORD = re.compile(rb" ?(?:[A-Za-z]|" + _ACCENTED + rb")++")
_PLAIN = re.compile(rb"[ \n]++(?:[!-~]|" + _ACCENTED + rb")++")
#: The character that stands for each byte in byte-level vocabularies: itself if it can be printed, else the next from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER_OF = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}
#: Words that go to the library at once; its cost for a word grows with the text.
WORDS = 2000
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9], np.uint64)

_open: dict[str, Encoder] = {}


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] values), then those of first[1], and so on."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Encoder:
    """Ids as the library gives them by default, no special tokens around a text."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS, step: int = STEP):
        self.tokenizer = Tokenizer.from_file(path)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added):
            raise ValueError("added tokens that match otherwise than letter by letter are not supported")
        self.added = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.cut = re.compile(b"|".join(map(re.escape, self.added)))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.top = max(vocabulary.values())
        self.width = np.zeros(self.top + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix("</w>"))
        self.spaced = len(self.tokenizer.encode(" \n", add_special_tokens=False).ids) > 0
        spec = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
        self.model = Tokenizer.from_str(json.dumps(spec))
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        probe = [b"Word", b" the", b" \xc3\x89t\xc3\xa9", b"zqXjk"]
        if self._words(probe)[0].tolist() != [i for c in probe for i in self.tokenizer.encode(c.decode(), add_special_tokens=False).ids]:
            raise ValueError(f"{path} is no byte-level tokenizer of a known kind")
        self.max_chunks, self.step = max_chunks, min(step, max_chunks)
        self.bits = (2 * max_chunks - 1).bit_length()
        self._empty()

    def _empty(self) -> None:
        self.n = self.used = 0
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = [np.empty(self.max_chunks, np.uint64) for _ in range(KEY_WORDS)]
        self.size = np.empty(self.max_chunks, np.int64)
        self.start, self.count = np.empty(self.max_chunks, np.int64), np.empty(self.max_chunks, np.int64)
        self.pool = np.empty(4 * self.max_chunks, np.uint32)

    # --- chunks ---

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Where added tokens lie in documents."""
        raw, docs = memoryview(np.ascontiguousarray(data)), set()
        whole = bytes(raw) if len(raw) else b""
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                docs.add(int(np.searchsorted(offsets, at, "right")) - 1)
                at = whole.find(token, at + 1)
        return [(int(offsets[d]) + m.start(), int(offsets[d]) + m.end()) for d in sorted(docs) for m in self.cut.finditer(raw[offsets[d] : offsets[d + 1]])]

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks start."""
        if not len(data):
            return np.zeros(0, np.int64)
        space, sign = _SPACE[data], _ASCII_SIGN[data]
        letter = _ASCII_LETTER[data]
        cut = np.zeros(len(data), bool)
        cut[1:] = space[1:] & ~space[:-1] | sign[1:] & letter[:-1]
        doubt = np.flatnonzero((space[1:] | sign[1:]) & (data[:-1] >= 0x80)) + 1
        if len(doubt):
            b1, b2, b3 = (data[np.maximum(doubt - k, 0)].astype(np.int64) for k in (1, 2, 3))
            wide = np.isin(b3 << 16 | b2 << 8 | b1, _WIDE) | np.isin(b2 << 8 | b1, _WIDE[_WIDE < 1 << 16])
            latin = (b2 == 0xC3) & (b1 != 0x97) & (b1 != 0xB7)
            cut[doubt] = np.where(space[doubt], ~wide, latin)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        for a, b in self._added(data, offsets):
            cut[a], cut[a + 1 : b] = True, False
            cut[b : b + 1] = True
        return np.flatnonzero(cut)

    # --- table ---

    def _keys(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The key words of chunks (zero beyond their end) and the slot where the search begins."""
        words = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        keys, mixed = [], size.astype(np.uint64) * _MIX[-1]
        for j in range(KEY_WORDS):
            k = np.zeros(len(start), np.uint64)
            some = np.flatnonzero(size > 8 * j) if j else slice(None)
            k[some] = words[start[some] + 8 * j] & _KEEP[np.minimum(size[some] - 8 * j, 8)]
            keys.append(k)
            mixed += k * _MIX[j]
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX[0]
        return keys, (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: list[np.ndarray], size: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The entry of each chunk, or -1."""
        out, todo, at = np.full(len(size), -1, np.int64), np.arange(len(size)), slot.copy()
        while len(todo):
            e = self.slots[at[todo]]
            held = e >= 0
            todo, e = todo[held], e[held]
            same = (self.keys[0][e] == keys[0][todo]) & (self.keys[1][e] == keys[1][todo]) & (self.size[e] == size[todo])
            large = np.flatnonzero(same & (size[todo] > 16))
            for j in range(2, KEY_WORDS):
                same[large] &= self.keys[j][e[large]] == keys[j][todo[large]]
            out[todo[same]] = e[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, keys: list[np.ndarray], size: np.ndarray, slot: np.ndarray) -> None:
        base, n = self.n, len(size)
        for held, k in zip(self.keys, keys, strict=True):
            held[base : base + n] = k
        self.size[base : base + n] = size
        todo, at = np.arange(n), slot.copy()
        while len(todo):
            free = todo[self.slots[at[todo]] < 0]
            self.slots[at[free]] = base + free
            todo = todo[self.slots[at[todo]] != base + todo]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        self.n += n

    def _words(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, how many each chunk has) of single words."""
        parts = []
        for i in range(0, len(chunks), WORDS):
            text = b"\n".join(chunks[i : i + WORDS])
            text = text if self.spaced else text.replace(b" ", b"").decode().lower().encode()
            mapped = text.replace(b"\n", b"\0").decode("latin-1").translate(_LETTER_OF).replace(_LETTER_OF[0], "\n")
            parts.append(np.array(self.model.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, np.uint32))
        return self._counted(parts, [len(c) - (not self.spaced and c[0] == 32) for c in chunks])

    def _counted(self, parts: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate(parts)
        return ids, np.diff(np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes), "right"), prepend=0)

    def _library(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, how many each has), from the library."""
        words, plain, rest = [], [], []
        for i, c in enumerate(chunks):
            (words if _WORD.fullmatch(c) else plain if _PLAIN.fullmatch(c) else rest).append(i)
        n, parts = np.zeros(len(chunks), np.int64), [np.zeros(0, np.uint32)]
        if words:
            ids, n[words] = self._words([chunks[i] for i in words])
            parts.append(ids)
        if plain:
            some = [chunks[i] for i in plain]
            found = self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)[0].ids
            ids, n[plain] = self._counted([np.array(found, np.uint32)], [len(c if self.spaced else c.lstrip(b" \n")) for c in some])
            parts.append(ids)
        if rest:
            found = [x.ids for x in self.tokenizer.encode_batch_fast([chunks[i].decode() for i in rest], add_special_tokens=False)]
            parts += [np.array(x, np.uint32) for x in found]
            n[rest] = [len(x) for x in found]
        order = np.array(words + plain + rest, np.int64)
        first = np.zeros(len(chunks), np.int64)
        first[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate(parts)[ranges(first, n)], n

    def _step(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of some chunks in a row, how many each has)."""
        keys, slot = self._keys(padded, start, size)
        short = size <= KEY_BYTES
        entry = self._find(keys, np.where(short, size, -1), slot)
        lost = np.flatnonzero(entry < 0)
        base = int(start[0])
        raw = padded[base : int(start[-1] + size[-1])].tobytes() if len(lost) else b""
        texts = [raw[a:b] for a, b in zip((start[lost] - base).tolist(), (start[lost] + size[lost] - base).tolist(), strict=True)]
        late, long = lost[short[lost]], lost[~short[lost]]
        fresh, whole = [texts[i] for i in np.flatnonzero(short[lost])], [texts[i] for i in np.flatnonzero(~short[lost])]
        first = dict(zip(reversed(fresh), reversed(late.tolist()), strict=True))
        if first:
            ids, n = self._library([*first])
            if self.n + len(first) > self.max_chunks or self.used + len(ids) > len(self.pool):
                self._empty()
                if len(ids) > len(self.pool):
                    self.pool = np.empty(2 * len(ids), np.uint32)
                return self._step(padded, start, size)
            some = np.array([*first.values()], np.int64)
            self.start[self.n : self.n + len(n)], self.count[self.n : self.n + len(n)] = self.used + np.cumsum(n) - n, n
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self._insert([k[some] for k in keys], size[some], slot[some])
            entry[late] = self._find([k[late] for k in keys], size[late], slot[late])
        begin, n, pool = self.start[entry], self.count[entry], self.pool
        if len(long):
            ids, m = self._library(whole)
            if self.used + len(ids) <= len(pool):
                pool[self.used : self.used + len(ids)] = ids
            else:
                pool = np.concatenate([pool[: self.used], ids])
            begin[long], n[long] = self.used + np.cumsum(m) - m, m
        return pool[ranges(begin, n)], n

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in a row, where each document's begin and the last one's end).

        Beside its ids, a document of n bytes takes 5 n bytes for its classes and 32 for each chunk.
        """
        start = self.starts(data, offsets)
        size = np.diff(start, append=len(data))
        padded = np.concatenate([data, np.zeros(KEY_BYTES + 8, np.uint8)])
        parts = [self._step(padded, start[i : i + self.step], size[i : i + self.step]) for i in range(0, len(start), self.step)]
        before = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))]) if parts else np.zeros(1, np.int64)
        ids = np.concatenate([x for x, _ in parts]) if parts else np.zeros(0, np.uint32)
        return ids, before[np.searchsorted(start, offsets)]

    def with_end(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with end_id after each document."""
        ids, at = self.encode(data, offsets)
        n = len(at) - 1
        return np.insert(ids, at[1:], np.uint32(end_id)), at + np.arange(n + 1)


def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and worker."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def close() -> None:
    """Gives up this worker's encoders; they are made again when needed."""
    _open.clear()


def encode_column(column: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text with end_id after them; nulls are empty.  About TEXT_BYTES of text are in work at once."""
    for _, _, data, offsets in ts.chunks(*ts.utf8(column), TEXT_BYTES):
        ids, at = encoder(path).with_end(data, offsets, end_id)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield ids[a:b]


def encode_texts(texts: list[str | None], path: str, end_id: int) -> list[np.ndarray]:
    """As encode_column, of a list."""
    return list(encode_column(pa.array(texts, pa.large_string()), path, end_id))
