"""Work of the Jaccard join on groups of copies that grow with the input."""

from __future__ import annotations

import random

from graphloom.llm import jaccard_join as jj

COLUMNS = "id bigint, n int, size int, c1 bigint, c2 bigint, p int, t bigint"


def roomy_pairs(rows: list[tuple]) -> set[tuple[int, int]]:
    def fits(a: tuple, b: tuple) -> bool:
        apart = not (a[3] == a[4] == b[3] == b[4])
        return a[6] == b[6] and a[0] > b[0] and apart and (jj.NUM + jj.DEN) * min(a[2], b[2]) >= jj.NUM * (a[1] + b[1])

    return {(a[0], b[0], a[6]) for a in rows for b in rows if fits(a, b)}


def test_rows_with_room_keep_all_pairs_and_few_others(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(200):  # classes of several components, too
        n, c = rnd.randint(20, 60), rnd.randrange(12)
        rows += [(i, n, n - rnd.randint(0, n // 4) - p, c, c if i % 9 else c + 1, p, t) for p, t in enumerate(rnd.sample(range(30), rnd.randint(1, 6)))]
    kept = [tuple(r) for r in jj._with_room(spark.createDataFrame(rows, COLUMNS)).collect()]
    assert set(kept) <= set(rows) and len(kept) == len(set(kept))
    assert roomy_pairs(kept) == roomy_pairs(rows) != set()
    # a group of near copies in one component and short sets that hold its hashes: nothing to pair
    group = [(i, 100, 90 - p, 0, 0, p, p) for i in range(300) for p in range(5)] + [(900 + p, 10, 9, 900 + p, 900 + p, 0, p) for p in range(5)]
    assert roomy_pairs(group) == set()
    assert jj._with_room(spark.createDataFrame(group, COLUMNS)).count() == 0


def test_texts_of_equal_sets_are_read_again_once(spark, monkeypatch):
    """A group of copies costs the second pass one set, not one for each copy."""
    seen, saved = {}, jj.saved

    def counted(df, tag):
        out = saved(df, tag)
        seen[tag] = seen.get(tag, 0) + out.count() if tag == "sets" else 0
        return out

    monkeypatch.setattr(jj, "saved", counted)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words)) for i in range(100)] + [(100, " ".join([*words[:-1], "z"])), (101, "a b c d e f g")]
    found = jj.join_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))[0]
    assert sorted(map(tuple, found.collect())) == [(i, 36, 0) for i in range(101)] + [(101, 3, 101)]
    assert seen["sets"] == 2


def test_repeated_ids_with_unlike_texts(spark):
    """An id stands for all of its rows' sets, in copies as in near copies."""
    one, two = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(5, " ".join(one)), (5, " ".join(two)), (5, " ".join(two)), (3, " ".join(two)), (8, " ".join([*one, "z"])), (9, " ".join(["z", *two]))]
    found = jj.join_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))[0]
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(5, 3), (3, 3), (8, 3), (9, 3)}


def test_cores_follow_their_definition(spark, monkeypatch):
    rnd = random.Random(7)
    for values in (1 << 20, 50):  # a block for all sets, and many
        monkeypatch.setattr(jj, "OPEN_VALUES", values)
        sets = {i: (i % 11, sorted(rnd.sample(range(-(2**63), 2**63, 2**63 // 200), 30) if i % 3 else rnd.sample(range(300), rnd.randint(1, 40)))) for i in range(90)}
        where: dict[int, list[int]] = {}
        for c, h in sets.values():
            for t in h:
                where.setdefault(t, []).append(c)
        core = {i: sorted((len(where[t]), t) for t in h if len(set(where[t])) > 1) for i, (c, h) in sets.items()}
        expected = {(i, len(sets[i][1]), sets[i][0], tuple(t for _, t in g)) for i, g in core.items() if g and 100 * len(g) >= 75 * len(sets[i][1])}
        rows = [(i, len(h), c, h) for i, (c, h) in sets.items()]
        found = jj._cores(spark.createDataFrame(rows, "id bigint, n int, c bigint, h array<bigint>"))
        assert {(r.id, r.n, r.c, tuple(r.g)) for r in found.collect()} == expected != set()
    assert jj._cores(spark.createDataFrame([], "id bigint, n int, c bigint, h array<bigint>")).count() == 0
