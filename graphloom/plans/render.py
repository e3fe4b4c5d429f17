"""Renderers as string folds over ordered rows; a diagram is one aggregate, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph


def fold(lines: DataFrame, order: Sequence[str], line: str = "line", keys: Sequence[str] = (), name: str = "content") -> DataFrame:
    """(keys, content): the lines in `order`, each ended by a newline."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("__line"))))
    text = F.concat(F.array_join(F.transform(rows, lambda r: r["__line"]), "\n"), F.lit("\n"))
    return lines.groupBy(*keys).agg(text.alias(name))


def node_id(c: Column | str) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(c, "[^A-Za-z0-9_]", "_"))


def hashed_id(prefix: str, c: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.col(c) if isinstance(c, str) else c), 1, 10))


def quoted(c: Column | str) -> Column:
    return F.replace(c, F.lit('"'), F.lit("'"))


def _line(a: int, b: Column, c: Column, text: Column, keys: Sequence[str]) -> list[Column]:
    return [*keys, F.lit(a).alias("a"), b.alias("b"), c.alias("c"), text.alias("line")]


def call_graph(edges: DataFrame, nodes: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """A Mermaid flowchart: nodes sorted, then edges."""
    keys = list(keys)
    all_nodes = graph.endpoints(edges, nodes, keys)
    head = all_nodes.select(*keys).distinct() if keys else edges.sparkSession.range(1)
    none = F.lit("")
    rows = head.select(_line(0, none, none, F.lit("flowchart TD"), keys))
    rows = rows.unionByName(all_nodes.select(_line(1, F.col("node"), none, F.concat(F.lit("    "), node_id("node"), F.lit('["'), quoted("node"), F.lit('"]')), keys)))
    rows = rows.unionByName(edges.select(*keys, "caller", "callee").distinct().select(_line(2, F.col("caller"), F.col("callee"), F.concat(F.lit("    "), node_id("caller"), F.lit(" --> "), node_id("callee")), keys)))
    return fold(rows, ["a", "b", "c"], keys=keys)


def sequence_diagram(messages: DataFrame, participants: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A Mermaid sequence diagram: participants by number (name, pos), messages (caller, callee, label, kind, pos); `:` in labels becomes `-`."""
    keys = list(keys)
    ids = participants.select(*keys, "name", F.concat(F.lit("p"), F.col("pos").cast("string")).alias("id"), F.col("pos").cast("long").alias("pos"))
    head = participants.select(*keys).distinct() if keys else participants.sparkSession.range(1)
    arrow = F.when(F.col("kind") == "return", F.lit("-->>")).otherwise(F.lit("->>"))
    text = lambda c: F.replace(c, F.lit(":"), F.lit("-"))
    rows = head.select(*keys, F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.lit("sequenceDiagram").alias("line"))
    rows = rows.unionByName(ids.select(*keys, F.lit(1).alias("a"), F.col("pos").alias("b"), F.concat(F.lit("    participant "), "id", F.lit(" as "), text("name")).alias("line")))
    joined = messages.join(ids.select(*keys, F.col("name").alias("caller"), F.col("id").alias("i1")), [*keys, "caller"]).join(ids.select(*keys, F.col("name").alias("callee"), F.col("id").alias("i2")), [*keys, "callee"])
    rows = rows.unionByName(joined.select(*keys, F.lit(2).alias("a"), F.col("pos").cast("long").alias("b"), F.concat(F.lit("    "), "i1", arrow, "i2", F.lit(": "), text("label")).alias("line")))
    return fold(rows, ["a", "b"], keys=keys)


def communication_diagram(messages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A Mermaid flowchart whose edges carry `number: label`."""
    keys = list(keys)
    nodes = graph.endpoints(messages, None, keys)
    head = nodes.select(*keys).distinct() if keys else messages.sparkSession.range(1)
    rows = head.select(*keys, F.lit(0).alias("a"), F.lit("").alias("b"), F.lit(0).cast("long").alias("c"), F.lit("flowchart LR").alias("line"))
    rows = rows.unionByName(nodes.select(*keys, F.lit(1).alias("a"), F.col("node").alias("b"), F.lit(0).cast("long").alias("c"), F.concat(F.lit("    "), node_id("node"), F.lit('["'), quoted("node"), F.lit('"]')).alias("line")))
    edge = F.concat(F.lit("    "), node_id("caller"), F.lit(' -->|"'), "number", F.lit(": "), quoted("label"), F.lit('"| '), node_id("callee"))
    rows = rows.unionByName(messages.select(*keys, F.lit(2).alias("a"), F.lit("").alias("b"), F.col("pos").cast("long").alias("c"), edge.alias("line")))
    return fold(rows, ["a", "b", "c"], keys=keys)


def state_diagram(transitions: DataFrame, initial: DataFrame, terminal: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A Mermaid state diagram; `*` is any state."""
    keys = list(keys)
    name = lambda c: F.when(F.col(c) == "*", F.lit("__any")).otherwise(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"))
    head = transitions.select(*keys).distinct() if keys else transitions.sparkSession.range(1)
    none = F.lit("")
    note = F.concat_ws(" ", F.col("event"), F.when(F.coalesce(F.col("condition"), none) != "", F.concat(F.lit("["), "condition", F.lit("]"))))
    rows = head.select(_line(0, none, none, F.lit("stateDiagram-v2"), keys))
    rows = rows.unionByName(initial.select(_line(1, F.col("state"), none, F.concat(F.lit("    [*] --> "), name("state")), keys)))
    rows = rows.unionByName(transitions.select(_line(2, F.col("source"), F.col("target"), F.concat(F.lit("    "), name("source"), F.lit(" --> "), name("target"), F.when(note != "", F.concat(F.lit(" : "), note)).otherwise(none)), keys)))
    rows = rows.unionByName(terminal.select(_line(3, F.col("state"), none, F.concat(F.lit("    "), name("state"), F.lit(" --> [*]")), keys)))
    return fold(rows, ["a", "b", "c"], keys=keys)


def class_diagram(classes: DataFrame, members: DataFrame, relations: DataFrame, plantuml: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """classes (keys, name, external), members (name, member, visibility, pos), relations (caller, callee, relation)."""
    mark = F.when(F.col("visibility") == "private", F.lit("-")).when(F.col("visibility") == "protected", F.lit("#")).otherwise(F.lit("+"))
    none = F.lit("")
    ident = lambda c: hashed_id("c_", c)
    keys = list(keys)
    head = classes.select(*keys).distinct() if keys else classes.sparkSession.range(1)
    top, bottom = ("@startuml", "@enduml") if plantuml else ("classDiagram", None)
    opened = F.concat(F.lit("class \"" if plantuml else "    class "), quoted("name") if plantuml else ident("name"), F.concat(F.lit('" as '), ident("name"), F.when(F.col("external"), F.lit(" <<external>>")).otherwise(none)) if plantuml else F.concat(F.lit('["'), quoted("name"), F.lit('"]')), F.lit(" {"))
    order = lambda a, b, c, k, text: [*keys, F.lit(a).alias("a"), b.alias("b"), F.lit(c).alias("c"), k.cast("long").alias("d"), text.alias("line")]
    zero = F.lit(0)
    rows = head.select(*order(0, none, 0, zero, F.lit(top)))
    rows = rows.unionByName(classes.select(*order(1, F.col("name"), 0, zero, opened))).unionByName(classes.select(*order(1, F.col("name"), 2, zero, F.lit("}" if plantuml else "    }"))))
    rows = rows.unionByName(members.select(*order(1, F.col("name"), 1, F.col("pos"), F.concat(F.lit("  " if plantuml else "        "), mark, "member", F.lit("()")))))
    link = F.when(F.col("relation") == "inheritance", F.concat(ident("callee"), F.lit(" <|-- "), ident("caller"))).otherwise(F.concat(ident("caller"), F.lit(" ..> "), ident("callee")))
    rows = rows.unionByName(relations.select(*order(2, F.concat("caller", F.lit("\u0001"), "callee", F.lit("\u0001"), "relation"), 0, zero, F.concat(F.lit("" if plantuml else "    "), link))))
    if bottom:
        rows = rows.unionByName(head.select(*order(3, none, 0, zero, F.lit(bottom))))
    return fold(rows, ["a", "b", "c", "d"], keys=keys)


def marked_graph(edges: DataFrame, nodes: DataFrame, marks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A dependency flowchart whose nodes carry classes: marks (node, mark) such as cycle, isolated or external."""
    keys = list(keys)
    head = nodes.select(*keys).distinct() if keys else nodes.sparkSession.range(1)
    none = F.lit("")
    shape = F.when(F.col("node").startswith("external:"), F.concat(F.lit("(["), F.lit('"'), F.expr("substring(node, 10)"), F.lit('"'), F.lit("])"))).otherwise(F.concat(F.lit('["'), quoted("node"), F.lit('"]')))
    rows = head.select(_line(0, none, none, F.lit("flowchart LR"), keys))
    rows = rows.unionByName(nodes.select(_line(1, F.col("node"), none, F.concat(F.lit("    "), node_id("node"), shape), keys)))
    rows = rows.unionByName(edges.select(*keys, "caller", "callee").distinct().select(_line(2, F.col("caller"), F.col("callee"), F.concat(F.lit("    "), node_id("caller"), F.lit(" --> "), node_id("callee")), keys)))
    rows = rows.unionByName(marks.select(_line(3, F.col("mark"), F.col("node"), F.concat(F.lit("    class "), node_id("node"), F.lit(" "), "mark"), keys)))
    return fold(rows, ["a", "b", "c"], keys=keys)


def markdown_table(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A pipe table; pipes in cells are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|"))
    body = rows.select(F.lit(2).alias("a"), F.struct(*order).alias("b"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("line"))
    head = F.concat(F.lit("| " + " | ".join(columns) + " |\n" + "|" + " --- |" * len(columns)))
    text = F.concat(head, F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "line"))), lambda r: r["line"]), "\n"), F.lit("\n"))
    return body.agg(text.alias("content"))


def csv_text(rows: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """CSV text: fields with a comma, quote or line break are quoted."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cell = lambda c: F.when(value(c).rlike("[,\"\\r\\n]"), F.concat(F.lit('"'), F.replace(value(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value(c))
    body = rows.select(F.struct(*order).alias("b"), F.concat_ws(",", *map(cell, columns)).alias("line"))
    return body.agg(F.concat(F.lit(",".join(columns) + "\r\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "line"))), lambda r: r["line"]), "\r\n"), F.lit("\r\n")).alias("content"))


def duplicate_paths(outputs: DataFrame) -> DataFrame:
    """(path, n): output paths that occur more than once; a sink refuses these before it writes."""
    return outputs.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")
