"""Diagrams, renderers, names and sinks."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions import names
from graphloom.plans import diagrams, render
from graphloom.sources import python_facts, sinks

CODE = """
class Base: pass
class Store(Base):
    '''Keeps things.'''
    def load(self):
        self.check()
        Other()
    def check(self):
        leaf()
class Other(Base):
    def run(self): pass
def leaf(): pass
def main():
    store = Store()
    Store.load(store)
    leaf()
"""


@pytest.fixture
def entities(spark):
    return python_facts.facts(spark.createDataFrame([("m", CODE)], "module_id string, source string"), "entities")


def test_graphs_of_a_module(entities):
    got = {(r.caller, r.callee) for r in diagrams.sequence_graph(entities).collect()}
    assert got == {("Store.load", "Store.check"), ("Store.check", "leaf"), ("main", "Store.load"), ("main", "leaf")}
    classes = {(r.caller, r.callee, r.relation) for r in diagrams.class_graph(entities).collect()}
    assert classes == {("Store", "Base", "inheritance"), ("Other", "Base", "inheritance"), ("Store", "Other", "uses")}
    assert {r.class_name: r.responsibility for r in diagrams.responsibilities(entities).collect()} == {"Base": "Manages base state and behavior.", "Store": "Keeps things.", "Other": "Coordinates other processing."}


def test_sequence_text(entities):
    text = diagrams.sequence_diagrams(entities).where("root = 'main'").first().content
    assert text.splitlines() == ["sequenceDiagram", "    participant p0 as main", "    participant p1 as Store.load", "    participant p2 as Store.check", "    participant p3 as leaf", "    p0->>p1: load", "    p1->>p2: check", "    p2->>p3: leaf", "    p0->>p3: leaf"]


def test_bundle_and_files(spark, tmp_path):
    edges = spark.createDataFrame([("a", "hub"), ("b", "hub"), ("c", "hub"), ("a", "x")], "caller string, callee string")
    out = diagrams.bundle(edges, None, "call_graph")
    rows = {r.diagram: r for r in out.collect()}
    assert set(rows) == {"a", "b", "c", "hub"} and rows["hub"].shared and rows["hub"].relative_dir == "shared"
    assert "n_a --> n_x" in rows["a"].content and "hub" not in rows["a"].content and rows["hub"].content.count("-->") == 3
    placed = sinks.placed(out, "call_graphs")
    assert sinks.write_files(placed, str(tmp_path)) == 4 and len(list(tmp_path.rglob("*.mmd"))) == 4
    with pytest.raises(ValueError, match="duplicate"):
        sinks.write_files(placed.union(placed), str(tmp_path))


def test_names(spark):
    df = spark.createDataFrame([("HTTPServer_run2Go", "app.on_save_file_clicked", "a/__init__.py")], "n string, h string, p string")
    r = df.select(names.words_a("n").alias("a"), names.humanize_handler("h").alias("h"), names.module_name("p", "root").alias("m"), names.component_name("p", "root").alias("c"), names.stable_output_name("k", F.lit("é!x")).alias("s")).first()
    assert r.a == ["httpserver", "run2", "go"] and r.h == "Save file" and r.m == "a" and r.c == "a" and r.s == f"k_{hashlib.sha256('é!x'.encode()).hexdigest()[:10]}_x"


def test_renderers(spark):
    tr = spark.createDataFrame([("*", "IDLE", "reset", None), ("IDLE", "RUN", "step", "ok")], "source string, target string, event string, condition string")
    one = spark.createDataFrame([("IDLE",)], "state string")
    assert render.state_diagram(tr, one, one).first().content.splitlines() == ["stateDiagram-v2", "    [*] --> IDLE", "    __any --> IDLE : reset", "    IDLE --> RUN : step [ok]", "    IDLE --> [*]"]
    rows = spark.createDataFrame([(1, 'a"b', "x|y"), (2, "c", None)], "i int, p string, q string")
    assert render.csv_text(rows, ["p", "q"], ["i"]).first().content == 'p,q\r\n"a""b",x|y\r\nc,\r\n'
    assert render.markdown_table(rows, ["p", "q"], ["i"]).first().content == '| p | q |\n| --- | --- |\n| a"b | x\\|y |\n| c |  |\n'
    classes = spark.createDataFrame([("A", False), ("B", True)], "name string, external boolean")
    members = spark.createDataFrame([("A", "run", "private", 0)], "name string, member string, visibility string, pos int")
    rel = spark.createDataFrame([("A", "B", "inheritance")], "caller string, callee string, relation string")
    assert "<|--" in render.class_diagram(classes, members, rel).first().content and "<<external>>" in render.class_diagram(classes, members, rel, plantuml=True).first().content


def test_cli_ci(spark, tmp_path, capsys):
    (tmp_path / "ci.yml").write_text("jobs:\n  b:\n    steps:\n      - run: make package\n")
    args = cli.parser().parse_args(["ci", str(tmp_path / "ci.yml"), "--check"])
    assert cli.run(spark, args) == 1 and "missing-test" in capsys.readouterr().out


def test_class_diagrams_show_relations_and_methods(spark):
    source = "class A(Ext):\n def m(self): B()\n def _p(self): pass\nclass B: pass\nclass C(B):\n def c(self): B()\nclass D(B): pass\n"
    entities = python_facts.facts(spark.createDataFrame([("m", source)], "module_id string, source string"), "entities")
    out = {r.diagram: r for r in diagrams.class_diagrams(entities).collect()}
    shared = out["B"].content.split("\n")
    assert out["B"].shared and shared[0] == "classDiagram" and sum("<|--" in x for x in shared) == 2 and sum("..>" in x for x in shared) == 2
    own = out["A"].content
    assert not out["A"].shared and "+m()" in own and "_p()" in own and own.count("<|--") == 1 and '"Ext"' in own
