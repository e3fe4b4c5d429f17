"""Quality rules as weak supervision: rules vote or abstain, EM estimates their accuracies.

Each document gets counts from one pass over its whole text.  Eight rules turn the
counts into votes (1 good, -1 bad, 0 abstain).  A document enters the model only
through its vote vector, and there are at most 3**8 of those, so the corpus is
summed to a table of vote vectors by a grouped count with map-side combine; EM runs
on that bounded table and gives each vector a posterior probability of quality.

Defined results: a null or empty text has no words and fails the base test; an empty
table gives an empty result; repeated rows are judged one by one; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .store import saved
from .workers import tidy

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS = 50
MAX_REPEAT = 50
KEEP = 0.5

_CASED = ts.byte_weights(False)
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = ts.byte_class([(65, 90)])
_LETTER = ts.byte_class([(65, 90), (97, 122), (0xC0, 0xFF)])
_DIGIT = ts.byte_class([(48, 57)])
_BANG = np.isin(np.arange(256), list(b"!"))
_HEAD = ~ts.byte_class([(0x80, 0xBF)])


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys with owners (ascending): which occur twice or more in their owner, and which are not the first there."""
    mixed = ts.mix(keys + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order] = same[:-1]
    twice[order] = same[:-1] | same[1:]
    return twice, later


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts and what the rules look at, for each document of a byte array."""
    mask = ts.SPACED[data]
    starts, ends, first = ts.spans(mask, offsets)
    n = np.diff(first)
    words = ts.word_hashes(data, starts, ends, _CASED)
    grams = ts.gram_hashes(words, 3)
    ok = np.flatnonzero(ts.inside(first, 3, len(grams)))
    owner = ts.owners(first)
    twice, _ = _repeated(grams[ok], owner[ok])
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[ok[twice] + j] = True
    lines, line_ends, line_first = ts.spans(data != 10, offsets)
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)
    lines, line_ends, line_owner = lines[has_word], line_ends[has_word], ts.owners(line_first)[has_word]
    _, later = _repeated(ts.word_hashes(data, lines, line_ends, _CASED), line_owner)
    size = len(offsets) - 1
    length = ends - starts
    alnum = np.concatenate([[0], np.cumsum(ts.ALNUM[data], dtype=np.int64)])
    return {
        "n_words": n,
        "word_chars": _sums(mask & _HEAD[data], offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_owner[later], minlength=size),
        "n_repeat_words": _sums(covered, first),
        "n_lines": np.bincount(line_owner, minlength=size),
        "n_upper": _sums(_UPPER[data], offsets),
        "n_letters": _sums(_LETTER[data], offsets),
        "n_digits": _sums(_DIGIT[data], offsets),
        "n_bangs": _sums(_BANG[data], offsets),
        "n_short": _sums(length <= 3, first),
        "n_bare": _sums(alnum[ends] == alnum[starts], first),
    }


#: name: (ratio, votes bad from, votes good below); between the two a rule abstains.  Fixed thresholds.
RULES = {
    "symbols": ("n_symbols / n_words", 0.15, 0.03),
    "upper": ("n_upper / n_letters", 0.25, 0.12),
    "repeats": ("n_repeat_words / n_words", 0.35, 0.20),
    "dup_lines": ("n_dup_lines / n_lines", 0.60, 0.40),
    "bangs": ("n_bangs / n_words", 0.15, 0.02),
    "digits": ("n_digits / word_chars", 0.15, 0.03),
    "few_short": ("1 - n_short / n_words", 0.95, 0.85),
    "bare_words": ("n_bare / n_words", 0.15, 0.03),
}


def votes(c: dict[str, np.ndarray]) -> np.ndarray:
    """One int8 column a rule; a document without words abstains everywhere."""
    per = {k: v.astype(float) for k, v in c.items()}
    top = lambda k: np.maximum(per[k], 1)
    ratio = {
        "symbols": per["n_symbols"] / top("n_words"),
        "upper": per["n_upper"] / top("n_letters"),
        "repeats": per["n_repeat_words"] / top("n_words"),
        "dup_lines": per["n_dup_lines"] / top("n_lines"),
        "bangs": per["n_bangs"] / top("n_words"),
        "digits": per["n_digits"] / top("word_chars"),
        "few_short": 1 - per["n_short"] / top("n_words"),
        "bare_words": per["n_bare"] / top("n_words"),
    }
    out = np.stack([np.where(ratio[k] >= bad, -1, np.where(ratio[k] < good, 1, 0)) for k, (_, bad, good) in RULES.items()], 1)
    out[c["n_words"] == 0] = 0
    return out.astype(np.int8)


def pattern_of(v: np.ndarray) -> np.ndarray:
    """The vote vector as one number in base 3."""
    return (v.astype(np.int64) + 1) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(len(RULES), dtype=np.int64) % 3 - 1).astype(np.int8)


def fit(patterns: np.ndarray, weights: np.ndarray, rounds: int = 300) -> dict[int, float]:
    """EM over counted vote vectors: the prior of quality and, for each rule and true class, how it votes or abstains.

    A junk document usually trips one or two rules while the others see nothing wrong,
    so a rule has its own chance of each vote in each class instead of one accuracy for
    both.  The start is a prior of 0.85 and a bad vote with chance 0.02 on good
    documents, 0.25 on bad ones; ten pseudo-documents hold the estimates near it while
    data are few.  A bad vote stays rarer than 0.03 on good documents and more frequent
    than 0.1 on bad ones, so the classes cannot swap.  Returns the posterior of each vector; without data there is none.
    """
    if not len(patterns):
        return {}
    v, w = votes_of(patterns), weights.astype(float)
    seen = np.stack([v == k for k in (-1, 0, 1)])  # vote, vector, rule
    start = np.array([[0.25, 0.25, 0.5], [0.02, 0.18, 0.8]])  # bad, good
    chance = np.repeat(start[:, :, None], v.shape[1], 2)
    prior, post = 0.85, np.zeros(len(v))
    for _ in range(rounds):
        log = [np.einsum("kpr,kr->p", seen, np.log(chance[c])) + np.log((1 - prior, prior)[c]) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
        for c, q in enumerate((w * (1 - post), w * post)):
            chance[c] = np.einsum("kpr,p->kr", seen, q) + 10 * start[c][:, None]
            chance[c] /= chance[c].sum(0)
        chance[1][0] = np.minimum(chance[1][0], 0.03)
        chance[0][0] = np.maximum(chance[0][0], 0.1)
        prior = float(np.clip((w @ post + 8.5) / (w.sum() + 10), 0.02, 0.98))
    return dict(zip(patterns.tolist(), post.tolist(), strict=True))


def _scan(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    parts = []
    for _, _, data, offsets in ts.chunks(*ts.utf8(column)):
        c = counts(data, offsets)
        parts.append((c, pattern_of(votes(c))))
    keys = parts[0][0].keys() if parts else COUNTS
    return {k: np.concatenate([p[0][k] for p in parts] or [np.zeros(0, np.int64)]) for k in keys}, np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])


def _base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT * c["n_words"])


def document_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base counts, base_failed, pattern): one row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, pattern = _scan(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(_base_failed(c)), pa.array(pattern)],
                ["id", *COUNTS, "base_failed", "pattern"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, {', '.join(f'{k} bigint' for k in COUNTS)}, base_failed boolean, pattern bigint"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def pattern_counts(patterns: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vote vectors and how many documents have them: at most 3**8 rows reach the driver."""
    rows = patterns.groupBy("pattern").count().collect()
    rows.sort(key=lambda r: r["pattern"])
    return np.array([r["pattern"] for r in rows], np.int64), np.array([r["count"] for r in rows], np.int64)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base counts, base_failed, posterior, kept) for each row of docs."""
    spark = docs.sparkSession
    counted = saved(document_counts(docs, id_col, text_col), "rules")
    model = fit(*pattern_counts(counted.select("pattern")))
    table = spark.createDataFrame([(k, v) for k, v in model.items()], "pattern bigint, posterior double")
    return counted.join(F.broadcast(table), "pattern", "left").select(
        F.col("id").alias(id_col), *COUNTS, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= KEEP)).alias("kept")
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that `judge` keeps, all columns, without a shuffle: votes are counted first, then taken again."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_scan(batch.column(0))[1])], ["pattern"])

    model = fit(*pattern_counts(docs.select(F.col(text_col).cast("string")).mapInArrow(tidy(vote), "pattern bigint")))
    kept = np.array(sorted(k for k, p in model.items() if p >= KEEP), np.int64)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, pattern = _scan(batch.column(at))
            yield batch.filter(pa.array(np.isin(pattern, kept) & ~_base_failed(c)))

    return docs.mapInArrow(tidy(run), docs.schema)
