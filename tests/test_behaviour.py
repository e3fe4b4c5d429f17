"""The renderers of objects, timing, CI, use cases, activities, reports and PlantUML sequences against written-out results."""

from __future__ import annotations

import hashlib

from graphloom.plans import behaviour


def text(df):
    (row,) = df.where("diagram = 'd'").collect()
    return row.content.split("\n")


def test_objects_and_activities(spark):
    nodes = spark.createDataFrame([("d", "a", "a", 'T"x', [("n", "1\n2")], 0), ("d", "b", "b", "U", [], 1), ("e", "a", "z", "Z", [], 0)], "diagram string, key string, name string, type_name string, fields array<struct<name:string,value:string>>, pos int")
    refs = spark.createDataFrame([("d", "a", "b", "x|y", 0), ("d", "a", "lost", "q", 1)], "diagram string, source string, target string, label string, pos int")
    assert text(behaviour.object_diagram(nodes, refs)) == ["flowchart LR", "    o0[\"a : T'x<br/>n = 1 2\"]", '    o1["b : U"]', "    o0 -->|x/y| o1", ""]
    steps = spark.createDataFrame([("d", "n.1", "if x", "decision", 0), ("d", "n2", "go", "call", 1)], "diagram string, id string, label string, kind string, pos int")
    flows = spark.createDataFrame([("d", "n.1", "n2", "yes", 0), ("d", "n2", "n.1", None, 1)], "diagram string, source string, target string, label string, pos int")
    assert text(behaviour.activity_flow(steps, flows)) == ["flowchart TD", "    act_n_1{if x}", "    act_n2[go]", "    act_n_1 -->|yes| act_n2", "    act_n2 --> act_n_1", ""]


def test_timing(spark):
    charts = spark.createDataFrame([("d", "m.f", True)], "diagram string, owner string, is_async boolean")
    events = spark.createDataFrame(
        [("d", 1, "call", "z", None), ("d", 2, "await", "a", "x"), ("d", 3, "parallel_join", None, "t"), ("d", 4, "sync_wait", None, None), ("d", 5, "timer", None, "9"), ("d", 6, "callback", "a", 'q"'), ("d", 10, "call", None, None)],
        "diagram string, ord int, kind string, target string, detail string",
    )
    assert text(behaviour.timing_chart(charts, events)) == [
        "sequenceDiagram", '    participant p0 as "m.f"', '    participant p1 as "a"', '    participant p2 as "z"', "    Note over p0: async flow",
        "    p0->>p2: 1. call z", "    p0->>p1: 2. await x", "    p1-->>p0: resume", "    Note over p0: 3. join t", "    Note over p0: 4. sync wait sync_wait",
        "    Note over p0: 5. timer 9", '    p0-)p1: 6. callback q\\"', "    Note over p0: 10. call call", "",
    ]


def test_ci_and_use_cases(spark):
    flows = spark.createDataFrame([("d", ["push", "pr"]), ("e", [])], "diagram string, triggers array<string>")
    jobs = spark.createDataFrame([("d", "a b", ["s1", "s2"], [], 0), ("d", "c", [], ["a b", "gone"], 1), ("e", "x", [], None, 0)], "diagram string, job string, steps array<string>, needs array<string>, pos int")
    shown = behaviour.ci_workflow(flows, jobs)
    assert text(shown) == ["flowchart LR", '    ci_trigger["push, pr"]', '    ci_a_b["a b<br/>s1<br/>s2"]', '    ci_c["c"]', "    ci_trigger --> ci_a_b", "    ci_a_b --> ci_c", ""]
    assert shown.where("diagram = 'e'").first().content == 'flowchart LR\n    ci_trigger["workflow"]\n    ci_x["x"]\n    ci_trigger --> ci_x\n'
    cases = spark.createDataFrame([("d", "User", "Save", "btn", "click", "on_save", ["f", "g"], 0), ("d", "Admin", "Go", "k", "key", "go", [], 1)], "diagram string, actor string, name string, component string, event string, handler string, call_chain array<string>, pos int")
    assert text(behaviour.use_case_diagram(cases)) == [
        "flowchart LR", '    actor1["Admin"]', '    actor2["User"]', '    uc1(["Save"])', '    actor2 -->|"btn / click"| uc1', "    %% handler-chain: on_save -> f -> g",
        '    uc2(["Go"])', '    actor1 -->|"k / key"| uc2', "    %% handler-chain: go", "",
    ]


def test_report_and_plantuml(spark):
    metrics = spark.createDataFrame([("d", "graph", "edges", "3", 0), ("e", "graph", "edges", "0", 0)], "diagram string, scope string, name string, value string, pos int")
    found = spark.createDataFrame([("d", "warning", "hub", "x", "5 of 3", "read", "n", 0), ("d", "info", "cyc", "y", "e", "i", None, 1)], "diagram string, severity string, code string, subject string, evidence string, interpretation string, note string, pos int")
    report = behaviour.design_quality_report(metrics, found)
    top = ["# Design quality report", "", "## Metrics", "", "| Scope | Metric | Value |", "| --- | --- | ---: |", "| graph | edges | 3 |", "", "## Findings", ""]
    assert text(report) == [*top, "### [WARNING] hub: x", "", "- Evidence: 5 of 3", "- Interpretation: read", "- Note: n", "", "### [INFO] cyc: y", "", "- Evidence: e", "- Interpretation: i", ""]
    assert report.where("diagram = 'e'").first().content.endswith("## Findings\n\nNo structural findings were detected with the current thresholds.\n")
    people = spark.createDataFrame([("d", 'a"', 0), ("d", "b", 1)], "diagram string, name string, pos int")
    said = spark.createDataFrame([("d", 'a"', "b", "go", "call", 0), ("d", "b", 'a"', "ok", "return", 1)], "diagram string, caller string, callee string, label string, kind string, pos int")
    a, b = ("p_" + hashlib.sha1(x.encode()).hexdigest()[:10] for x in ('a"', "b"))
    assert text(behaviour.plantuml_sequence(said, people)) == ["@startuml", f'participant "a\\"" as {a}', f'participant "b" as {b}', f"{a} -> {b} : go", f"{b} --> {a} : ok", "@enduml", ""]
