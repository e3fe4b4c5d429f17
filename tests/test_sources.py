"""Parsers and scans: small sources and the rows they give."""

from __future__ import annotations

from graphloom.sources import files, python_facts

MACHINE = """
from enum import Enum
from . import c
from ..m import x
import a.b
class State(Enum):
    IDLE = 1
    RUNNING = 2
    DONE = 3
class Worker(Base, Generic[T]):
    '''Works.'''
    def __init__(self):
        self.state = State.IDLE
    def step(self, a, *rest, key=1, **more):
        if self.state == State.IDLE:
            self.state = State.RUNNING
        elif self.state is State.RUNNING:
            self.state = State.DONE
        outer(inner(a), helper())
        self.step()
        helper()
    def _reset(self):
        self.state = State.IDLE
if True:
    def hidden(): pass
repo = Repo('db.sqlite', timeout=30)
repo.owner = boss
"""

ASYNC = """
async def main(loop):
    task = asyncio.create_task(work())
    await asyncio.sleep(1.5)
    async with lock:
        await asyncio.gather(a(), b())
    loop.call_later(2, tick)
    task.add_done_callback(done)
    while True:
        await step()
    with self.lock:
        plain()
"""

GUI = """
class App:
    def build(self):
        self.save = Button(root, text='Save', command=self.on_save)
        root.bind('<Return>', self.enter)
        widget.bind(on_press=self.press)
        self.view.clicked.connect(self.clicked)
"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sources(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, source string").selectExpr("cast(n as string) as module_id", "source")


def test_entities_and_imports(spark):
    src = sources(spark, MACHINE, "def broken(", None)
    found = {r.qname: r for r in python_facts.facts(src, "entities").collect()}
    assert set(found) == {"State", "Worker", "Worker.__init__", "Worker.step", "Worker._reset"}
    step = found["Worker.step"]
    assert step.kind == "method" and step.parameters == ["self", "a", "*rest", "key", "**more"]
    assert step.call_sequence == ["outer", "inner", "helper", "self.step", "helper"] and step.calls == ["outer", "inner", "helper", "self.step"]
    assert found["Worker"].bases == ["Base", "Generic[T]"] and found["Worker"].docstring == "Works." and found["Worker._reset"].visibility == "protected"
    assert [r.ref for r in python_facts.facts(src, "imports").orderBy("pos").collect()] == ["enum", ".c", "..m", "a.b"]
    assert [(r.module_id, r.kind) for r in python_facts.facts(src, "errors").collect()] == [("1", "unsupported_syntax")]


def test_states_and_objects(spark):
    src = sources(spark, MACHINE)
    m = python_facts.facts(src, "state_machines").first()
    assert (m.owner, m.state_variable, m.initial_state, m.terminal_states) == ("Worker", "state", "IDLE", ["DONE"])
    assert [(t.source, t.target, t.event) for t in m.transitions] == [("IDLE", "RUNNING", "step"), ("RUNNING", "DONE", "step"), ("*", "IDLE", "_reset")]
    o = python_facts.facts(src, "objects").first()
    assert (o.name, o.type_name) == ("repo", "Repo") and [tuple(v) for v in o.field_values] == [("arg1", "'db.sqlite'"), ("timeout", "30")] and [tuple(v) for v in o.refs] == [("owner", "boss")]


def test_objects_on_attributes(spark):
    src = sources(spark, "class Repo: pass\nx = Repo()\nx.child = Repo(y)\nx.child.size = 3\nx.other = a.b\ny.z = 1\nclass S:\n def __init__(self):\n  self.repo = Repo()\n  self.repo.mode = 'r'\n  self.name = 'n'\n")
    got = [(r.scope, r.name, r.type_name, [tuple(v) for v in r.field_values], [tuple(v) for v in r.refs]) for r in python_facts.facts(src, "objects").orderBy("line").collect()]
    assert got == [
        (None, "x", "Repo", [], [("child", "x.child"), ("other", "a.b")]),
        (None, "x.child", "Repo", [("size", "3")], []),
        ("S.__init__", "self.repo", "Repo", [("mode", "'r'")], []),
    ]


def test_listing_of_a_folder_and_of_one_file(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "Dockerfile").write_text("FROM x\n")
    assert [r.path for r in files.listing(spark, str(tmp_path)).collect()] == ["a/Dockerfile"]
    assert [r.path for r in files.listing(spark, str(tmp_path / "a" / "Dockerfile")).collect()] == ["Dockerfile"]


def test_timing_inputs_activity(spark):
    kinds = [r.kind for r in python_facts.facts(sources(spark, ASYNC), "timing").orderBy("ord").collect()]
    assert kinds == ["parallel_start", "wait", "sync", "parallel_start", "parallel_start", "parallel_join", "timer", "callback", "periodic", "await", "sync", "call"]
    got = [(r.component, r.event, r.handler, r.label, r.scope) for r in python_facts.facts(sources(spark, GUI), "inputs").orderBy("line").collect()]
    assert got == [("self.save", "command", "self.on_save", "Save", "App"), ("root", "<Return>", "self.enter", None, "App"), ("widget", "on_press", "self.press", None, "App"), ("self.view", "clicked", "self.clicked", None, "App")]
    flow = python_facts.facts(sources(spark, "def f(x):\n if x:\n  a()\n else:\n  return 1\n for i in x: b()\n"), "activity").collect()
    assert [r.kind for r in flow if r.row == "node"] == ["start", "decision", "call", "return", "merge", "decision", "call", "merge", "end"]
    assert sum(r.row == "edge" for r in flow) == 10


def test_discovery(spark, tmp_path):
    for p in ("a.py", "src/B.GD", "build/x.py", "src/build", "deploy/Dockerfile", "docker-compose.yml", "k.yaml", "note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1\n")
    found = files.listing(spark, str(tmp_path))
    assert [(r.path, r.language) for r in files.supported_files(found).collect()] == [("a.py", "python"), ("docker-compose.yml", "yaml"), ("k.yaml", "yaml"), ("src/B.GD", "gdscript")]
    assert [(r.path, r.kind) for r in files.deployment_files(found).collect()] == [("deploy/Dockerfile", "dockerfile"), ("docker-compose.yml", "compose"), ("k.yaml", "kubernetes")]
    assert files.read_sources(spark, str(tmp_path), "*.py").count() == 2


CI = """
on: push
env: {TOKEN: "${{ secrets.DEPLOY }}"}
jobs:
  test:
    runs-on: ubuntu-latest
    strategy: {matrix: {python: ["3.11", 3.12]}}
    steps:
      - uses: actions/checkout@v4
      - name: Unit
        run: pytest tests/unit src/app.py --flag
        env: {A: "${{ env.B }}"}
      - uses: actions/cache@v3
        with: {path: "~/.cache\\nbuild", key: k}
  build:
    needs: test
    steps:
      - run: make build
      - foo: bar
"""

K8S = """
kind: Deployment
metadata: {name: web}
spec: {template: {metadata: {labels: {app: web, tier: "1"}}, spec: {containers: [{image: nginx}]}}}
---
kind: Service
metadata: {name: web}
spec: {selector: {app: web}}
---
kind: Ingress
metadata: {name: in}
spec: {rules: [{http: {paths: [{backend: {service: {name: web}}}, {backend: {service: {name: ghost}}}]}}]}
"""


def test_ci_tables(spark):
    from graphloom.sources import yaml_facts

    src = sources(spark, CI, "- a", "")
    jobs = {r.job: r for r in yaml_facts.ci_jobs(src).where("error is null").collect()}
    assert jobs["build"].needs == ["test"] and [tuple(m) for m in jobs["test"].matrix] == [("python", "str", "3.11"), ("python", "float", "3.12")]
    steps = yaml_facts.ci_steps(src).where("error is null").orderBy("job", "pos").collect()
    assert [(s.job, s.name) for s in steps] == [("build", "make build"), ("test", "actions/checkout@v4"), ("test", "Unit"), ("test", "actions/cache@v3")]
    unit = steps[2]
    assert unit.path_hints == ["tests/unit", "src/app.py"] and unit.env_refs == ["B"] and unit.env_names == ["A"]
    assert (steps[3].resource_kind, steps[3].resource_key, steps[3].resource_paths) == ("cache", "k", ["~/.cache", "build"])
    assert [r.module_id for r in yaml_facts.ci_jobs(src).where("error is not null").collect()] == ["1"]


def test_deployment_tables(spark):
    from graphloom.sources import yaml_facts

    nodes, edges = yaml_facts.kubernetes(sources(spark, K8S))
    assert {r.id for r in nodes.collect()} == {"k8s:deployment:web", "k8s:service:web", "k8s:ingress:in"}
    assert {(r.source, r.target) for r in edges.collect()} == {("k8s:service:web", "k8s:deployment:web"), ("k8s:ingress:in", "k8s:service:web")}
    compose = "services:\n  web: {image: app, depends_on: [db, gone], links: ['db:x'], ports: ['80:80']}\n  db: {image: 'postgres:16'}\n"
    got = yaml_facts.compose(sources(spark, compose)).collect()
    assert {(r.id, r.kind) for r in got if r.row == "node"} == {("service:web", "service"), ("service:db", "database")}
    assert sorted((r.kind, r.target) for r in got if r.row == "edge") == [("depends_on", "service:db"), ("links", "service:db")]
    docker = "FROM --platform=x python:3.12 AS base\n# FROM no\nfrom base\nRUN FROM\n"
    assert [r.image for r in yaml_facts.dockerfile(sources(spark, docker)).orderBy("pos").collect()] == ["python:3.12", "base"]


def test_wire_responses(spark):
    import json

    from graphloom.sources import wire

    good = {"contract_version": "1", "request_id": "r", "ok": True, "ir": {"language": "csharp", "entities": [{"kind": "class", "name": "A", "line": 3, "visibility": "odd"}], "imports": ["x"]}}
    bad = {**good, "ir": {"entities": [{"kind": "interface", "name": "B", "line": 1}]}}
    failed = {"request_id": "r", "ok": False, "error": {"kind": "timeout", "retryable": True}}
    raw = spark.createDataFrame([("a", "r", json.dumps(good)), ("b", "r", json.dumps(bad)), ("c", "r", json.dumps(failed)), ("d", "other", json.dumps(good)), ("e", "r", "no json")], "module_id string, request_id string, response string")
    parsed = wire.responses(raw)
    assert {r.module_id: r.failure for r in parsed.collect()} == {"a": None, "b": "protocol_error", "c": "timeout", "d": "protocol_error", "e": "protocol_error"}
    e = wire.entities(parsed).first()
    assert (e.name, e.end_line, e.visibility) == ("A", 3, "unspecified") and wire.imports(parsed).first().ref == "x"


def test_comments(spark):
    from graphloom.sources import comments

    text = "class LoadData:\r\n    # has one\r\n    def run(self):\r\n        pass\r\n    def is_ready(self): pass\r\n    def __init__(self): pass\r\n"
    src = sources(spark, text)
    found = comments.candidates(src, "python")
    assert [(r.line, r.name, r.comment) for r in found.orderBy("line").collect()] == [(1, "LoadData", "# Represents load data."), (5, "is_ready", "# Checks ready.")]
    out = comments.insert(src, found).first().source
    assert out.startswith("# Represents load data.\r\nclass LoadData:\r\n") and "    # Checks ready.\r\n    def is_ready" in out and out.endswith("pass\r\n")
    again = comments.candidates(spark.createDataFrame([("0", out)], "module_id string, source string"), "python")
    assert again.count() == 0
    go = comments.candidates(sources(spark, "type T struct {\n\tName string\n}\nfunc (t T) Get() int {\nfunc main() {\n"), "go")
    assert [(r.target, r.name) for r in go.orderBy("line").collect()] == [("class", "T"), ("field", "Name"), ("method", "Get"), ("function", "main")]
