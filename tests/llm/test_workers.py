"""What a Python worker keeps between tasks, and how much the pipeline's stages send it at once."""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from graphloom.llm import jaccard_join, tokens, workers


def held_after(monkeypatch, docs, make):
    """What is left of open encoders after the function that a query gives to mapInArrow has run here."""
    ran = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema, *a, **b: ran.append(f) or self.limit(0))
    with contextlib.suppress(Exception):  # the rest of a plan needs what the function would have given
        make()
    monkeypatch.undo()
    monkeypatch.setitem(tokens._open, "path", object())
    list(ran[0]([]))
    return list(tokens._open)


def test_a_stage_without_tokens_gives_up_the_workers_encoders(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words", "en", "s", 10)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for stage in (corpus_pipeline.quality, corpus_pipeline.personal_data):
        assert held_after(monkeypatch, docs, lambda stage=stage: stage(spark, docs, "")) == []
    monkeypatch.setitem(tokens._open, "path", object())
    assert list(workers.tidy(iter, encodes=True)([1, 2])) == [1, 2]
    assert list(tokens._open) == ["path"]
    assert list(workers.tidy(iter)([])) == [] and not tokens._open


def test_stages_send_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, kept in (("10000", "1000"), ("0", "1000"), ("7", "7")):
            spark.conf.set(key, given)
            corpus_pipeline.small_batches(spark)
            assert spark.conf.get(key) == kept
    finally:
        spark.conf.set(key, before)


def test_blocks_send_the_half_with_top_bit_0(monkeypatch):
    monkeypatch.setattr(jaccard_join, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    texts = ["one two three four five six seven", None, "a b", " ".join(f"w{i}" for i in range(300))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(texts)], ["id", "t"])
    rows = [r for out in jaccard_join._send(3)([batch]) for r in out.to_pylist()]
    found = sorted((int(r["bucket"]) << 32 | int(k), int(w)) for r in rows if r["kind"] == "hashes" for k, w in zip(*jaccard_join._unpack(r["data"]), strict=True))
    data = "".join(t or "" for t in texts).encode()
    offsets = np.cumsum([0, *(len((t or "").encode()) for t in texts)])
    sets = jaccard_join.shingle_sets(np.frombuffer(data, np.uint8), offsets)
    assert found == sorted((int(x) >> 28, i) for i, s in enumerate(sets) for x in s.tolist() if not x >> 63)
    assert [len(s) for s in sets] == [3, 0, 1, 296]
