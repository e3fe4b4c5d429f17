"""Graph, partition, resolution, sequence and rule operators: small exact facts and brute force on random graphs."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import evaluate, graph, partition, resolve, sequence


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b) for a, b in pairs], "caller string, callee string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def nodes_of(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_degrees(spark):
    e = edges_of(spark, [("a", "b"), ("a", "b"), ("c", "b"), ("b", "a")])
    assert rows(graph.fan_in(e, nodes_of(spark, ["lone"]))) == [("a", 1), ("b", 2), ("c", 0), ("lone", 0)]
    assert rows(graph.fan_out(e)) == [("a", 1), ("b", 1), ("c", 1)]
    assert rows(graph.high_fan_in(e, 2)) == [("b", 2)]
    with pytest.raises(ValueError):
        graph.high_fan_in(e, 0)


def test_first_of_keeps_the_first_row(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "first"), ("j", 5, None)], "key string, pos int, v string")
    assert rows(graph.first_of(df, ["key"], ["pos"])) == [("j", 5, None), ("k", 1, "first")]


def test_reach(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")])
    root = nodes_of(spark, ["a"])
    assert rows(graph.reachable(e, root)) == [("a", 0), ("b", 1), ("c", 2)]
    near = graph.reachable(e, root, 1)
    assert rows(near) == [("a", 0), ("b", 1)] and rows(graph.reachable_edges(e, near, 1)) == [("a", "b")]
    assert rows(graph.reachable(e, root, 0)) == [("a", 0)]


def test_strong_components_by_both_ways(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "d"), ("x", "y"), ("y", "z"), ("z", "y")]
    e = edges_of(spark, pairs)
    want = [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("isolated", "isolated"), ("x", "x"), ("y", "y"), ("z", "y")]
    assert rows(graph.strong_components(e, nodes_of(spark, ["isolated"]))) == want
    monkeypatch.setattr(graph, "SMALL_EDGES", 0)
    found = graph.strong_components(e, nodes_of(spark, ["isolated"]))
    assert rows(found) == want
    assert rows(graph.cyclic_nodes(e, found)) == [("a",), ("b",), ("c",), ("d",), ("y",), ("z",)]
    assert len(rows(graph.cycle_edges(e, found))) == 6


@pytest.mark.parametrize("small", [0, 1000])
def test_weak_components_of_several_graphs(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL_EDGES", small)
    e = spark.createDataFrame([(1, "b", "a"), (1, "b", "c"), (1, "x", "y"), (2, "x", "b")], "g int, caller string, callee string")
    assert rows(graph.weak_components(e, keys=["g"])) == [(1, "a", "a"), (1, "b", "a"), (1, "c", "a"), (1, "x", "x"), (1, "y", "x"), (2, "b", "b"), (2, "x", "b")]


def test_cycles(spark):
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("d", "d"), ("c", "x")])
    assert rows(graph.elementary_cycles(e).select(F.array_join("path", ""))) == [("aba",), ("abca",), ("dd",)]
    with pytest.raises(ValueError, match="open paths"):
        graph.elementary_cycles(e, 0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_tarjan_is_mutual_reach(pairs):
    nodes = sorted({n for p in pairs for n in p})
    reach = {a: {a} for a in nodes}
    for _ in nodes:
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    assert graph.tarjan(nodes, pairs) == {a: min(b for b in nodes if b in reach[a] and a in reach[b]) for a in nodes}


FACTS = {
    "chain": ([("a", "b"), ("b", "c"), ("c", "d")], 3, [("a", 0, None, "abcd")]),
    "branches": ([("A", "B"), ("A", "X"), ("B", "C"), ("B", "D"), ("C", "E"), ("C", "F")], 4, [("A", 0, None, "AX"), ("B", 1, "A", "BD"), ("C", 2, "B", "CEF")]),
    "blocked": ([("A", "B"), ("A", "X"), ("B", "C"), ("B", "D"), ("X", "C")], 4, [("A", 0, None, "ABCDX")]),
    "hub": ([("first", "shared"), ("second", "shared"), ("shared", "sink")], 2, [("first", 0, None, "first"), ("second", 0, None, "second"), ("sink", 0, None, "sink")]),
    "cycle": ([("A", "B"), ("A", "X"), ("B", "C"), ("C", "B")], 3, [("A", 0, None, "ABCX")]),
}


@pytest.mark.parametrize("name", FACTS)
def test_partition_facts(spark, name):
    pairs, threshold, want = FACTS[name]
    series, hubs = partition.partition(edges_of(spark, pairs), None, threshold)
    got = sorted(tuple(r) for r in series.groupBy("series_root", "depth", "parent_root").agg(F.array_join(F.array_sort(F.collect_list("node")), "")).collect())
    assert got == sorted(want)
    assert [r[0] for r in rows(hubs)] == (["shared"] if name == "hub" else [])
    stats = {r.metric: r.value for r in partition.statistics(edges_of(spark, pairs), None, series, hubs).collect()}
    assert stats["cross_series_edge_count"] == (2 if name == "branches" else 0) and stats["series_count"] == len(want)


def test_isolated_node_is_a_series(spark):
    series, _ = partition.partition(edges_of(spark, [("a", "b")]), nodes_of(spark, ["lone"]))
    assert {r.series_root for r in series.collect()} == {"a", "lone"}


def test_call_ladder(spark):
    known = spark.createDataFrame([("A.run",), ("A.help",), ("main",), ("B.help",)], "name string")
    calls = spark.createDataFrame([("main", None), ("self.run", "A"), ("help", "A"), ("run", None), ("os.path", "A"), ("cls.help", "B")], "raw string, parent string")
    assert {r.raw: r.target for r in resolve.resolve_calls(calls, known).collect()} == {"main": "main", "self.run": "A.run", "help": "help", "run": "A.run", "os.path": "os.path", "cls.help": "B.help"}


def test_class_and_object_references(spark):
    known = spark.createDataFrame([("pkg.Base",), ("Other",), ("x.Twin",), ("y.Twin",)], "name string")
    refs = spark.createDataFrame([("pkg.Base.method",), ("Base",), ("lib.Other.x",), ("Twin",), ("none",)], "ref string")
    assert {r.ref: r.target for r in resolve.resolve_classes(refs, known).collect()} == {"pkg.Base.method": "pkg.Base", "Base": "pkg.Base", "lib.Other.x": "Other", "Twin": None, "none": None}
    objects = spark.createDataFrame([(None, "repo"), ("f", "db"), ("g", "db")], "scope string, name string")
    asked = spark.createDataFrame([(None, "repo"), ("f", "db"), ("h", "db"), ("h", "repo")], "scope string, name string")
    assert rows(resolve.resolve_objects(asked, objects).select("scope", "name", "target")) == [("f", "db", "f:db"), ("h", "repo", "<module>:repo"), (None, "repo", "<module>:repo")]


def test_packages_and_components(spark):
    units = spark.createDataFrame([("pkg", True, "pkg"), ("pkg.a", False, "pkg"), ("pkg.b", False, "pkg"), ("pkg.lone", False, "pkg"), ("ui.view", False, "ui"), ("data.repo", False, "data")], "name string, is_package boolean, component string")
    imports = spark.createDataFrame([("pkg.a", ".b"), ("pkg.b", ".a"), ("ui.view", "data.repo"), ("ui.view", "requests.api"), ("data.repo", "ui.view"), ("data.repo", "requests")], "module string, ref string")
    assert rows(resolve.package_edges(imports, units)) == [("data.repo", "ui.view"), ("pkg.a", "pkg.b"), ("pkg.b", "pkg.a"), ("ui.view", "data.repo")]
    assert rows(resolve.component_edges(imports, units)) == [("data", "external:requests"), ("data", "ui"), ("ui", "data"), ("ui", "external:requests")]


def test_selectors(spark):
    selectors = spark.createDataFrame([("s", "app", "web"), ("s", "tier", "1"), ("t", "app", "db")], "selector string, k string, v string")
    labels = spark.createDataFrame([("w1", "app", "web"), ("w1", "tier", "1"), ("w2", "app", "web"), ("w3", "app", "db")], "target string, k string, v string")
    assert rows(resolve.selector_matches(selectors, labels)) == [("s", "w1"), ("t", "w3")]


CALLS = [("main", 0, "helper"), ("main", 1, "tail"), ("helper", 0, "leaf"), ("leaf", 0, "main")]


def test_preorder_and_numbers(spark):
    calls = spark.createDataFrame(CALLS, "caller string, pos int, callee string")
    found = sequence.preorder(calls, nodes_of(spark, ["main"]))
    made = [(r.caller, r.callee, r.depth) for r in found.orderBy("ord").collect()]
    assert made == [("main", "helper", 0), ("helper", "leaf", 1), ("main", "tail", 0)]
    back = [(r.callee, r.kind) for r in sequence.preorder(calls, nodes_of(spark, ["main"]), show_returns=True).orderBy("ord").collect()]
    assert back == [("helper", "call"), ("leaf", "call"), ("helper", "return"), ("main", "return"), ("tail", "call"), ("main", "return")]
    messages = spark.createDataFrame([(1, i, d) for i, d in enumerate([0, 0, 1, 0])], "g int, pos int, depth int")
    assert [r.number for r in sequence.number_messages(messages, ["g"], max_depth=2).orderBy("pos").collect()] == ["1", "2", "2.1", "3"]
    skipped = spark.createDataFrame([(1, 0, 1)], "g int, pos int, depth int")
    assert sequence.number_messages(skipped, ["g"], max_depth=2).first().number == "0.1"


def test_expansion_hides_repeats(spark):
    calls = spark.createDataFrame([("g", a, b, b, i) for i, (a, b) in enumerate([("m", "h"), ("m", "h"), ("h", "x"), ("m", "k"), ("k", "h")])], "graph_id string, caller string, callee string, label string, pos int")
    roots = spark.createDataFrame([("g", "m")], "graph_id string, node string")
    assert [(r.caller, r.callee) for r in sequence.expand(calls, roots).orderBy("pos").collect()] == [("m", "h"), ("h", "x"), ("m", "k"), ("k", "h")]
    blocked = spark.createDataFrame([("g", "h", "x")], "graph_id string, caller string, callee string")
    assert [(r.caller, r.callee) for r in sequence.expand(calls, roots, blocked).orderBy("pos").collect()] == [("m", "h"), ("m", "k"), ("k", "h")]
    assert [r.node for r in sequence.call_chains(calls.drop("label"), roots, 5).orderBy("pos").collect()] == ["h", "x", "k"]


def test_ci_rules(spark):
    steps = spark.createDataFrame(
        [("w", "a", 0, "run pytest", "pytest"), ("w", "b", 0, "build it", "make "), ("w", "c", 0, "compile", "make"), ("v", "x", 0, "package", "zip")], "workflow string, job string, pos int, name string, command string"
    ).withColumn("text", evaluate.step_text("name", "command", F.lit(None).cast("string")))
    steps = steps.withColumn("is_test", evaluate.is_test(F.col("text"))).withColumn("is_build", evaluate.is_build(F.col("text")))
    needs = spark.createDataFrame([("w", "b", "a")], "workflow string, job string, need string")
    assert rows(evaluate.missing_test(steps)) == [("v",)]
    assert rows(evaluate.build_without_test(steps, needs)) == [("w", "c")]
    assert rows(evaluate.duplicate_commands(steps)) == [("w", "make", 2, "b, c")]
    lines = spark.createDataFrame([("w", "a", "pytest"), ("w", "b", "pytest\n"), ("w", "c", None), ("w", "d", "")], "workflow string, job string, command string")
    assert rows(evaluate.duplicate_commands(lines)) == [("w", "pytest", 2, "a, b")]
    flows = spark.createDataFrame([("w",), ("v",), ("empty",)], "workflow string")
    assert sorted(rows(evaluate.missing_test(steps, workflows=flows))) == [("empty",), ("v",)]


def test_merge_keeps_confident_first(spark):
    df = spark.createDataFrame([("n", "inferred", 0, "a"), ("n", "confirmed", 1, "b"), ("n", "confirmed", 2, "c")], "id string, confidence string, pos int, label string")
    assert rows(evaluate.merge_confident(df, ["id"], evaluate.confidence_rank(F.col("confidence")), ["pos"])) == [("n", "confirmed", 1, "b")]


def test_random_partitions_cover_all_nodes(spark):
    rnd = random.Random(0)
    for _ in range(300):
        nodes = "abcdefgh"[: rnd.randint(2, 8)]
        pairs = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(rnd.randint(1, 12))]
        scc = graph.tarjan(sorted(set(nodes)), pairs)
        cyclic = {n for n in nodes if sum(scc[m] == scc[n] for m in nodes) > 1 or (n, n) in pairs}
        series = partition.split_component(set(nodes), pairs, cyclic, 2)
        placed = [n for _, _, _, members in series for n in members]
        assert sorted(placed) == sorted(nodes) and series[0][1] == 0
