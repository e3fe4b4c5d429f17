"""Renderers of objects, timing, CI, use cases, activities, quality reports and PlantUML sequences.

As in `render`, a diagram is one aggregate over ordered rows.  All of them render many
diagrams at once, one for each value of `keys`; `pos` columns give the order from 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .render import fold, hashed_id

KEYS = ("diagram",)
#: How kinds of timing events are named in messages and notes where it isn't the kind itself; fixed values.
MESSAGE_WORDS = {"call": "call", "await": "await", "parallel_start": "parallel start", "timer": "timer", "callback": "callback"}
MESSAGE_ARROWS = {"call": "->>", "await": "->>", "parallel_start": "-)", "timer": "-)", "callback": "-)"}
NOTE_WORDS = {"parallel_join": "join", "sync_wait": "sync wait"}


def escaped(c: Column | str) -> Column:
    """Backslashes and quotes behind a backslash, on one line."""
    behind = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.replace(behind, F.lit("\n"), F.lit(" "))


def label(c: Column | str) -> Column:
    """On one line, quotes as apostrophes."""
    return F.translate(c, '\r\n"', "  '")


def _lines(rows: DataFrame, keys: Sequence[str], part: int, line: Column, b: Column | None = None, c: Column | None = None) -> DataFrame:
    zero = F.lit(0)
    return rows.select(*keys, F.lit(part).alias("part"), *((zero if x is None else x).cast("long").alias(n) for n, x in (("b", b), ("c", c))), line.alias("line"))


def _folded(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    return fold(reduce(DataFrame.unionByName, parts), ["part", "b", "c"], keys=keys)


def _text(*parts: Column | str) -> Column:
    """The parts in a row: strings are literals."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _numbered(rows: DataFrame, keys: Sequence[str], column: str, prefix: str) -> DataFrame:
    """(keys, column, number, id): the distinct values of a diagram in order, from 1."""
    names = rows.where(F.col(column) != "").groupBy(*keys).agg(F.array_sort(F.collect_set(column)).alias("v"))
    found = names.select(*keys, F.posexplode("v").alias("i", column))
    return found.select(*keys, column, (F.col("i") + 1).alias("number"), _text(prefix, (F.col("i") + 1).cast("string")).alias("id"))


def object_diagram(nodes: DataFrame, references: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """nodes (key, name, type_name, fields of (name, value), pos), references (source, target, label, pos) between them."""
    keys = list(keys)
    ids = nodes.select(*keys, "key", _text("o", F.col("pos").cast("string")).alias("id"))
    fields = F.transform("fields", lambda f: label(_text(f["name"], " = ", f["value"])))
    shown = F.concat_ws("<br/>", F.concat(F.array(label(_text(F.col("name"), " : ", F.col("type_name")))), fields))
    ends = references.join(ids.select(*keys, F.col("key").alias("source"), F.col("id").alias("i1")), [*keys, "source"])
    ends = ends.join(ids.select(*keys, F.col("key").alias("target"), F.col("id").alias("i2")), [*keys, "target"])
    edge = F.replace(label("label"), F.lit("|"), F.lit("/"))
    return _folded([
        _lines(nodes.select(*keys).distinct(), keys, 0, F.lit("flowchart LR")),
        _lines(nodes, keys, 1, _text("    o", F.col("pos").cast("string"), '["', shown, '"]'), F.col("pos")),
        _lines(ends, keys, 2, _text("    ", F.col("i1"), " -->|", edge, "| ", F.col("i2")), F.col("pos")),
    ], keys)


def timing_chart(charts: DataFrame, events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """charts (owner, is_async), events (ord, kind, target, detail): relations in time, no durations."""
    keys = list(keys)
    targets = _numbered(events, keys, "target", "p")
    rows = events.join(targets, [*keys, "target"], "left")
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    detail = escaped(F.coalesce(given("detail"), given("target"), F.col("kind")))
    order = _text(F.col("ord").cast("string"), ". ")
    pick = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("kind"))
    resume = F.when(F.col("kind") == "await", _text("\n    ", F.col("id"), "-->>p0: resume")).otherwise(F.lit(""))
    message = _text("    p0", pick(MESSAGE_ARROWS), F.col("id"), ": ", order, pick(MESSAGE_WORDS), " ", detail, resume)
    note = _text("    Note over p0: ", order, F.coalesce(pick(NOTE_WORDS), F.col("kind")), " ", detail)
    return _folded([
        _lines(charts, keys, 0, _text("sequenceDiagram\n    participant p0 as \"", escaped("owner"), '"')),
        _lines(targets, keys, 1, _text("    participant ", F.col("id"), ' as "', escaped("target"), '"'), F.col("number")),
        _lines(charts.where("is_async"), keys, 2, F.lit("    Note over p0: async flow")),
        _lines(rows, keys, 3, F.coalesce(message, note), F.col("ord")),
    ], keys)


def ci_workflow(workflows: DataFrame, jobs: DataFrame, keys: Sequence[str] = KEYS, direction: str = "LR") -> DataFrame:
    """workflows (triggers), jobs (job, steps, needs, pos): needs of jobs that the workflow has, else the trigger."""
    keys = list(keys)
    ident = lambda c: _text("ci_", F.regexp_replace(c, "[^0-9A-Za-z_]", "_"))
    known = jobs.groupBy(*keys).agg(F.collect_set("job").alias("known"))
    ready = jobs.join(known, keys).withColumn("before", F.filter(F.coalesce("needs", F.array().cast("array<string>")), lambda n: F.array_contains("known", n)))
    link = lambda before: _text("    ", before, " --> ", ident(F.col("job")))
    arrows = F.when(F.size("before") == 0, F.array(link(F.lit("ci_trigger")))).otherwise(F.transform("before", lambda n: link(ident(n))))
    trigger = F.when(F.size("triggers") > 0, F.array_join("triggers", ", ")).otherwise(F.lit("workflow"))
    return _folded([
        _lines(workflows, keys, 0, _text(f'flowchart {direction}\n    ci_trigger["', trigger, '"]')),
        _lines(jobs, keys, 1, _text("    ", ident("job"), '["', F.concat_ws("<br/>", F.array("job"), "steps"), '"]'), F.col("pos")),
        _lines(ready, keys, 2, F.array_join(arrows, "\n"), F.col("pos")),
    ], keys)


def use_case_diagram(use_cases: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """use_cases (actor, name, component, event, handler, call_chain, pos)."""
    keys = list(keys)
    actors = _numbered(use_cases, keys, "actor", "actor")
    rows = use_cases.join(actors.select(*keys, "actor", "id"), [*keys, "actor"])
    case = _text("uc", (F.col("pos") + 1).cast("string"))
    chain = F.concat_ws(" -> ", F.array("handler"), "call_chain")
    shown = _text(
        "    ", case, '(["', escaped("name"), '"])\n    ', F.col("id"), ' -->|"', escaped(_text(F.col("component"), " / ", F.col("event"))), '"| ', case,
        "\n    %% handler-chain: ", escaped(chain),
    )
    return _folded([
        _lines(use_cases.select(*keys).distinct(), keys, 0, F.lit("flowchart LR")),
        _lines(actors, keys, 1, _text("    ", F.col("id"), '["', escaped("actor"), '"]'), F.col("number")),
        _lines(rows, keys, 2, shown, F.col("pos")),
    ], keys)


def activity_flow(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = KEYS, direction: str = "TD") -> DataFrame:
    """nodes (id, label, kind, pos), edges (source, target, label, pos); decisions are rhombs."""
    keys = list(keys)
    ident = lambda c: _text("act_", F.regexp_replace(c, "[^0-9A-Za-z_]", "_"))
    shape = F.when(F.col("kind") == "decision", _text("{", F.col("label"), "}")).otherwise(_text("[", F.col("label"), "]"))
    mark = F.when(F.col("label") != "", _text("|", F.col("label"), "|")).otherwise(F.lit(""))
    return _folded([
        _lines(nodes.select(*keys).distinct(), keys, 0, F.lit(f"flowchart {direction}")),
        _lines(nodes, keys, 1, _text("    ", ident("id"), shape), F.col("pos")),
        _lines(edges, keys, 2, _text("    ", ident("source"), " -->", mark, " ", ident("target")), F.col("pos")),
    ], keys)


def design_quality_report(metrics: DataFrame, findings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Markdown: metrics (scope, name, value, pos), findings (severity, code, subject, evidence, interpretation, note, pos)."""
    keys = list(keys)
    heads = metrics.select(*keys).unionByName(findings.select(*keys)).distinct()
    note = F.when(F.col("note") != "", _text("\n- Note: ", F.col("note"))).otherwise(F.lit(""))
    finding = _text(
        "### [", F.upper("severity"), "] ", F.col("code"), ": ", F.col("subject"), "\n\n- Evidence: ", F.col("evidence"),
        "\n- Interpretation: ", F.col("interpretation"), note, "\n",
    )
    none = heads.join(findings.select(*keys).distinct(), keys, "left_anti")
    folded = _folded([
        _lines(heads, keys, 0, F.lit("# Design quality report\n\n## Metrics\n\n| Scope | Metric | Value |\n| --- | --- | ---: |")),
        _lines(metrics, keys, 1, _text("| ", F.col("scope"), " | ", F.col("name"), " | ", F.col("value").cast("string"), " |"), F.col("pos")),
        _lines(heads, keys, 2, F.lit("\n## Findings\n")),
        _lines(findings, keys, 3, finding, F.col("pos")),
        _lines(none, keys, 3, F.lit("No structural findings were detected with the current thresholds.")),
    ], keys)
    return folded.withColumn("content", _text(F.regexp_replace("content", r"\s+$", ""), "\n"))


def plantuml_sequence(messages: DataFrame, participants: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """messages (caller, callee, label, kind, pos), participants (name, pos)."""
    keys = list(keys)
    alias = lambda c: hashed_id("p_", c)
    heads = messages.select(*keys).unionByName(participants.select(*keys)).distinct()
    arrow = F.when(F.col("kind") == "return", F.lit(" --> ")).otherwise(F.lit(" -> "))
    return _folded([
        _lines(heads, keys, 0, F.lit("@startuml")),
        _lines(participants, keys, 1, _text('participant "', escaped("name"), '" as ', alias("name")), F.col("pos")),
        _lines(messages, keys, 2, _text(alias("caller"), arrow, alias("callee"), " : ", escaped("label")), F.col("pos")),
        _lines(heads, keys, 3, F.lit("@enduml")),
    ], keys)
