"""List keys of the Jaccard join: their definition, and a cost that doesn't follow the number of frequent hashes."""

from __future__ import annotations

import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from graphloom.llm import jaccard_join as jj

BITS, LIMIT = 6, 4


def random_sets(count: int, most: int) -> list[np.ndarray]:
    rng = np.random.RandomState(3)
    return [np.unique(rng.randint(0, 1 << 63, rng.randint(1, most)).astype(np.uint64) * np.uint64(2) + np.uint64(1)) for _ in range(count)]


def frequent(sets: list[np.ndarray], count: int) -> np.ndarray:
    held = np.concatenate(sets)[::3] >> np.uint64(31 - BITS)
    return np.unique(np.concatenate([held, np.random.RandomState(4).randint(0, 1 << 38, count).astype(np.uint64)]))


def keys(sets: list[np.ndarray], often: np.ndarray) -> list[tuple[int, int, int, int]]:
    h = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int32()), h], ["id", "n", "h"])
    return sorted(tuple(r.values()) for out in jj._keys(BITS, LIMIT, SimpleNamespace(value=often))([batch]) for r in out.to_pylist())


def expected(sets: list[np.ndarray], often: np.ndarray) -> list[tuple[int, int, int, int]]:
    held, out = set(often.tolist()), []
    for i, s in enumerate(sets):
        if len(s) > LIMIT:
            rank = [(1 if x >> 63 else 2 * (x >> 31 - BITS in held), x) for x in s.tolist()]
            out += [(x, i, len(s), 0) for _, x in sorted(rank)[: jj.prefix_length(len(s))]]
        if jj.partner_sizes(len(s))[0] <= LIMIT:
            out += [(int(x), i, len(s), small) for found, small in jj.light_keys(s, LIMIT) for x in found]
    return sorted((int(np.uint64(x).view(np.int64)), *r) for x, *r in out)


def test_keys_follow_their_definition(monkeypatch):
    sets = random_sets(150, 90) + random_sets(40, 6)
    for often in (np.zeros(0, np.uint64), frequent(sets, 1), frequent(sets, 1000)):
        assert keys(sets, often) == expected(sets, often)
    monkeypatch.setattr(jj, "KEY_VALUES", 64, raising=False)
    assert keys(sets, often) == expected(sets, often)
    assert keys(sets[:0], often) == []


def test_a_set_costs_the_same_however_many_hashes_are_frequent():
    sets = random_sets(100, 900)
    often = frequent(sets, 400_000)
    began = time.process_time()
    found = keys(sets, often)
    assert time.process_time() - began < 5
    assert found == expected(sets, often)
