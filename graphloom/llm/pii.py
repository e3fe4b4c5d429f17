"""Personal data: base patterns, then a skip-chain conditional random field over the candidates of a document.

Base matches are found by pattern, and so are secrets: values of 16 signs or more, letters
and four digits or more among them, that are assigned to a name such as `token` or `key`.
Secrets are a kind of their own and no base matches.  Nodes of the field are both and every
other token with an `@` or four digits or more.  Neighbours in the text share chain
potentials; nodes with the same digits (seven or more), the same address or secret, however far
apart, share skip potentials.  A repeat is a node only where it is one token: one written
with spaces, or with another prefix, is not linked.  Loopy sum-product passes messages until the
labels of a document agree; a token that the patterns miss but that repeats a found
number, address or secret in another notation or place gets its label.  Matches are
evidence and always stay.

Weights are learnt by pseudo-likelihood from base labels on about TRAIN_DOCS documents:
those with the smallest id hashes, of which only lines with candidates are gathered.

Defined results: null and empty texts have no spans; repeated rows are judged one by
one; a null id keeps its row; an empty table gives an empty result and needs no model.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import sample_by_hash

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET, OTHER = KINDS.index("secret"), len(KINDS)
TRAIN_DOCS = 20_000
from .workers import tidy
THRESHOLD = 0.9
CHAIN_GAP = 40
ROUNDS, DAMPING = 30, 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match that fails at the first digit of a run fails at the others too, and a match ends with its run.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A name, a sign of assignment and a value without white space.
_ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passphrase|key)[a-z0-9_-]{0,20}[\"']?[\x20\t]{0,3}(?::=|=>|[=:])[\x20\t]{0,3}[\"']?([a-z0-9_+/=.~-]{16,})")
_LONG = re.compile(r"[A-Za-z0-9_+/=.~-]{16,}")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9@]\S*")
_EDGE = ".,;:!?()[]{}<>\"'"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As finditer, but each run of address characters is looked at once."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            last = found.end()
        else:
            last = at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base matches, by kind and start."""
    out = [(0, *s) for s in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _mixed(token: str) -> bool:
    return len(_digits(token)) >= 4 and any(c.isalpha() for c in token)


def secrets(text: str) -> list[Span]:
    """Assigned values that look drawn at random."""
    return [(SECRET, *m.span(1)) for m in _ASSIGNED.finditer(text) if _mixed(m[1])]


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Tokens outside all found spans with an `@` or four digits or more, without the signs around them."""
    taken = sorted((a, b) for _, a, b in base)
    out, done, i, reach = [], 0, 0, 0
    for found in _TOKEN.finditer(text):
        start, end = found.span()
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = end
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while i < len(taken) and taken[i][0] < end:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= start and ("@" in text[start:end] or len(_digits(text[start:end])) >= 4):
            out.append((start, end))
    return out


FEATURES = 17


def features(token: str) -> np.ndarray:
    """The shape of a token; nothing says whether a base pattern matched it."""
    digits = _digits(token)
    n = len(digits)
    head, _, tail = token.partition("@")
    return np.array([
        1, bool(head and tail), "." in tail, bool(tail) and not tail.strip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-."),
        token.count(".") == 3 and n >= 4, n < 9, 9 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19,
        token[0] == "+", 13 <= n <= 19 and luhn(digits), any(c.isalpha() for c in token), " " in token, "-" in token or "(" in token,
        secret := bool(_LONG.fullmatch(token)) and _mixed(token), secret and not token.strip("0123456789abcdefABCDEF"),
    ], float)


def key_of(token: str) -> str:
    """What similar tokens have in common: the address or secret in lower case, or all digits."""
    return token.lower() if "@" in token or _LONG.fullmatch(token) and _mixed(token) else _digits(token)


class Graph:
    """Nodes (start, end), evidence (a kind, or -1) and the edges of one document."""

    def __init__(self, text: str, base: list[Span], free: list[tuple[int, int]]):
        nodes = sorted([(a, b, k) for k, a, b in base] + [(a, b, -1) for a, b in free])
        self.nodes = nodes
        self.label = np.array([k for _, _, k in nodes], np.int64)
        tokens = [text[a:b] for a, b, _ in nodes]
        self.x = np.array([features(t) for t in tokens]).reshape(-1, FEATURES)
        chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= CHAIN_GAP]
        skip, first, last = [], {}, {}
        for i, t in enumerate(tokens):
            k = key_of(t)
            if len(k) >= 7:
                if k in last:
                    skip.append((last[k], i))
                    if first[k] != last[k]:
                        skip.append((first[k], i))
                first.setdefault(k, i)
                last[k] = i
        self.edges = np.array(chain + skip, np.int64).reshape(-1, 2)
        self.skip = np.arange(len(self.edges)) >= len(chain)


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def marginals(g: Graph, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Loopy sum-product: the label distribution of each node, with damped, parallel messages."""
    phi = g.x @ unary.T
    known = g.label >= 0
    phi[known] = -1e6
    phi[known, g.label[known]] = 0
    e = np.concatenate([g.edges, g.edges[:, ::-1]])
    psi = np.where(np.concatenate([g.skip, g.skip])[:, None, None], skip, chain)
    half = len(g.edges)
    back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
    msg = np.zeros((2 * half, OTHER + 1))
    for _ in range(ROUNDS):
        total = phi.copy()
        np.add.at(total, e[:, 1], msg)
        new = _logsumexp((total[e[:, 0]] - msg[back])[:, :, None] + psi, 1) if half else msg
        new -= _logsumexp(new, 1)[:, None] if half else 0
        step = np.abs(new - msg).max(initial=0)
        msg = DAMPING * msg + (1 - DAMPING) * new
        if step < 1e-6:
            break
    total = phi.copy()
    np.add.at(total, e[:, 1], msg)
    return np.exp(total - _logsumexp(total, 1)[:, None])


def fit(graphs: list[Graph], steps: int = 2000, rate: float = 1.0, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unary, chain, skip) weights that maximise the pseudo-likelihood of the base labels.

    A base match has its kind, any other candidate is OTHER, but one that is linked to a
    base match is in doubt and teaches nothing.  Each node is predicted from
    its shape and the labels of its neighbours; potentials are made symmetric at the end.
    """
    n = OTHER + 1
    rows, ys = [], []
    for g in graphs:
        y = np.where(g.label < 0, OTHER, g.label)
        near, far = np.zeros((len(y), n)), np.zeros((len(y), n))
        for (a, b), s in zip(g.edges, g.skip, strict=True):
            side = far if s else near
            side[a, y[b]] += 1
            side[b, y[a]] += 1
        sure = (g.label >= 0) | (far[:, :OTHER].sum(1) == 0)
        rows.append(np.concatenate([g.x, np.minimum(near, 1), np.minimum(far, 1)], 1)[sure])
        ys.append(y[sure])
    # As many pseudo-nodes for each label as it has nodes, with nothing but a skip link, state that the same number keeps its label.
    seen = np.bincount(np.concatenate(ys), minlength=n)
    for k in range(n):
        times = max(8, int(seen[k]))
        rows.append(np.concatenate([np.zeros(FEATURES), np.zeros(n), np.eye(n)[k]])[None].repeat(times, 0))
        ys.append(np.full(times, k))
    x, y = np.concatenate(rows), np.concatenate(ys)
    w = np.zeros((n, x.shape[1]))
    goal = np.eye(n)[y]
    weight = 1 / np.maximum(goal.sum(0), 1)[y] / n
    for _ in range(steps):
        z = x @ w.T
        p = np.exp(z - _logsumexp(z, 1)[:, None])
        w -= rate * (((p - goal) * weight[:, None]).T @ x * 4 + decay * w)
    chain, skip = w[:, FEATURES : FEATURES + n], w[:, FEATURES + n :]
    return w[:, :FEATURES], (chain + chain.T) / 2, (skip + skip.T) / 2


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def find(text: str | None, model: Model | None) -> tuple[list[Span], list[Span]]:
    """(base spans, secrets and spans that the field adds)."""
    if not text or not _HINT.search(text):
        return [], []
    base, more = base_spans(text), secrets(text)
    free = candidates(text, base + more)
    if not free or model is None:
        return base, more
    g = Graph(text, base + more, free)
    p = marginals(g, *model)
    best = p.argmax(1)
    return base, more + [(int(best[i]), a, b) for i, (a, b, k) in enumerate(g.nodes) if k < 0 and best[i] != OTHER and p[i, best[i]] >= THRESHOLD]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_docs: int = TRAIN_DOCS) -> Model | None:
    """A model from a bounded, repeatable sample of documents with candidates; None without any."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_lines(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])

    hinted = sample_by_hash(docs, id_col, n_docs).select(F.col(text_col).cast("string").alias("t")).where(F.col("t").rlike(r"[0-9]{4}|@|[=:]\s*[\"']?[A-Za-z0-9_+/-]{16}"))
    rows = sorted(hinted.mapInArrow(tidy(shapes), "t string").collect())
    graphs = []
    for r in rows:
        found = base_spans(r["t"]) + secrets(r["t"])
        g = Graph(r["t"], found, candidates(r["t"], found))
        if len(g.nodes):
            graphs.append(g)
    return fit(graphs) if graphs else None


def _lines(text: str) -> str:
    """The lines of a text that hold candidates: all that training looks at."""
    return "\n".join(x for x in text.split("\n") if _HINT.search(x))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans) for each row of docs.

    The counts of the first four kinds are of base matches; n_secret and n_spans count `spans`.
    """
    model = model or train(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, spans = [[] for _ in range(6)], [], []
            for text in batch.column(1):
                base, more = find(text.as_py(), model)
                for k in range(4):
                    n[k].append(sum(s[0] == k for s in base))
                n[4].append(sum(s[0] == SECRET for s in more))
                n[5].append(len(base) + len(more))
                digest.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in n[:4]), pa.array(digest, pa.string()), pa.array(spans, pa.string()), *(pa.array(c, pa.int64()) for c in n[4:])], ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "n_spans"])

    schema = f"id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_secret bigint, n_spans bigint"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; spans that overlap are one, named by the first."""
    out, last = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{KINDS[k].upper()}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", model: Model | None = None) -> DataFrame:
    """docs with personal data masked in the text and the length column brought up to date; all columns, no shuffle."""
    model = model or train(docs, id_col, text_col)
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, changed = batch.column(at).to_pylist(), batch.column(length).to_pylist() if length is not None else [], False
            for i, text in enumerate(texts):
                base, more = find(text, model)
                if base or more:
                    texts[i], changed = masked(text, base + more), True
                    if length is not None:
                        sizes[i] = len(texts[i])
            if changed:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, columns[at].type)
                if length is not None:
                    columns[length] = pa.array(sizes, columns[length].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(tidy(run), docs.schema)
