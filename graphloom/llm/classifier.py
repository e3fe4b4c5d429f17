"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

One pass turns each text into statistics (ratios and logarithms of counts).  Moments,
normal equations and calibration counts are summed in each partition and then in a
tree of a fixed fan-in, so what reaches the driver is a few matrices whatever the
number of partitions.  The random features approximate a Gaussian kernel on the
standardised statistics; ridge regression on them predicts the label; isotonic
regression over score bins, from training rows that ridge did not see, makes the
output a probability that rises with the score.

Inputs of a score are the text's statistics alone.  Training rows are chosen by the
caller's id rule; held-out rows never enter a sum of labels.

Defined results: null and empty texts have zero statistics and get the score of such;
without training labels every score is 0.5; a label row without a label or document is
left out, repeated label rows count once (the highest label); repeated documents and
null ids are scored row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .quality_rules import counts
from .store import saved

N_FEATURES, SEED, RIDGE = 160, 17, 1.0
BINS, FAN_IN, ROWS = 2048, 16, 4096
POSITIVE = 0.7


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One float32 row for each document."""
    c = {k: v.astype(float) for k, v in counts(data, offsets).items()}
    per = lambda a, b: c[a] / np.maximum(c[b], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), per("word_chars", "n_words"), np.sqrt(per("n_symbols", "n_words")), per("n_dup_lines", "n_lines"), np.sqrt(per("n_repeat_words", "n_words")), np.log1p(per("n_words", "n_lines")),
            np.sqrt(per("n_upper", "n_letters")), np.sqrt(per("n_digits", "word_chars")), np.sqrt(per("n_bangs", "n_words")), per("n_short", "n_words"), np.sqrt(per("n_bare", "n_words")), per("n_letters", "word_chars"),
        ],
        1,
    ).astype(np.float32)


N_STATS = 12


def tree_sum(df: DataFrame, fan_in: int = FAN_IN) -> np.ndarray | None:
    """Sum of the float64 vectors in df's only column `v`, at most fan_in of them on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column(0):
                x = np.frombuffer(v.as_py())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    df = saved(df, "sums")
    n = df.count()
    while n > fan_in:
        n = -(-n // fan_in)
        df = df.repartition(n).mapInArrow(add, "v binary")
    rows = [np.frombuffer(r[0]) for r in df.collect()]
    # The order of partitions is not fixed: rounding is kept out of the result by summing in sorted order.
    return np.sum(sorted(rows, key=lambda x: x.tobytes()), axis=0) if rows else None


def _vectors(df: DataFrame, step: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                x = step(batch.slice(first, ROWS))
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], ["v"])

    return tree_sum(df.mapInArrow(run, "v binary"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, N_STATS).astype(float)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel whose width is the root of the dimension, and a constant."""
        draw = np.random.RandomState(SEED)
        omega, phase = draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], N_FEATURES)), draw.uniform(0, 2 * np.pi, N_FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ omega + phase
        return np.concatenate([np.sqrt(2 / N_FEATURES) * np.cos(z), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return np.clip(np.interp(raw, self.knots, self.levels), 0, 1) if self.knots is not None else np.clip(raw, 0, 1)


def isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the best non-decreasing rates for ordered bins with counts."""
    blocks: list[list[float]] = []
    for g, t in zip(good.tolist(), total.tolist(), strict=True):
        blocks.append([g, t, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + t2, blocks[-1][2] + n2]
    return np.concatenate([np.full(n, g / t) for g, t, n in blocks])


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in ts.chunks(*ts.utf8(batch.column(1))):
                x = statistics(data, offsets)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_STATS)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], ["id", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, x array<float>")


def fit(stats: DataFrame, labelled: DataFrame) -> Model | None:
    """stats (x) give the moments; labelled (x, y, calibrate) the ridge rows and, where `calibrate`, the isotonic ones."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

    total = _vectors(stats.select("x"), moments)
    if total is None or not total[0]:
        return None
    mean = total[1 : N_STATS + 1] / total[0]
    model = Model(mean, np.sqrt(np.maximum(total[N_STATS + 1 :] / total[0] - mean**2, 1e-4)))
    d = N_FEATURES + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z, y = model.lift(_matrix(batch.column(0))), np.asarray(batch.column(1), float)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _vectors(labelled.where("not calibrate").select("x", "y"), normal)
    if sums is None:
        return model
    model.weights = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * np.eye(d), sums[d * d :])

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
        y = np.asarray(batch.column(1), float)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)])

    found = _vectors(labelled.where("calibrate").select("x", "y"), bins)
    if found is not None:
        n, good = found[:BINS], found[BINS:]
        used = np.flatnonzero(n)
        model.knots = (used + 0.5) / BINS * 2 - 0.5
        model.levels = isotonic(good[used], n[used])
    return model


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) for each row of docs.

    A row is held out if crc32 of its id as text leaves 2 modulo 4; of the others,
    remainder 3 calibrates and the rest fit the ridge.
    """
    stats = saved(document_statistics(docs, id_col, text_col), "stats")
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % 4
    known = labels.select(F.col(label_id).alias("k"), F.col(label_col).cast("double").alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    labelled = stats.withColumn("f", fold).where("f != 2").join(known, F.col("id") == F.col("k")).select("x", "y", (F.col("f") == 3).alias("calibrate"))
    model = fit(stats, saved(labelled, "labelled"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([model.score(_matrix(batch.column(2).slice(i, ROWS))) for i in range(0, batch.num_rows, ROWS)]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= POSITIVE).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = stats.select("id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "x")
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
