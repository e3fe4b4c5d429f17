"""Ordered call expansion, hierarchical numbering, call chains and participants."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import saved


def preorder(calls: DataFrame, roots: DataFrame, max_depth: int = 8, show_returns: bool = False) -> DataFrame:
    """(root, ord, depth, caller, callee, kind): all messages below each root, repeats shown.

    calls: (caller, pos, callee).  Level by level; a row carries its positions (`ord`,
    which sorts in pre-order) and the active path, which no call may re-enter.  Every
    level is materialised.  A return sorts behind all that its call started.
    """
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    state = roots.select(F.col("node").alias("root"), F.col("node").alias("at"), F.array("node").alias("active"), F.array().cast("array<int>").alias("ord"))
    out = None
    for depth in range(max_depth):
        step = state.join(calls.select(F.col("caller").alias("at"), "pos", "callee"), "at").where(~F.array_contains("active", F.col("callee")))
        level = saved(step.select("root", F.array_append("ord", F.col("pos").cast("int")).alias("ord"), F.lit(depth).alias("depth"), F.col("at").alias("caller"), "callee", F.array_append("active", F.col("callee")).alias("active")), "level")
        if level.isEmpty():
            break
        rows = level.select("root", "ord", "depth", "caller", "callee", F.lit("call").alias("kind"))
        if show_returns:
            back = level.select("root", F.array_append("ord", F.lit(2147483647)).alias("ord"), "depth", F.col("callee").alias("caller"), F.col("caller").alias("callee"), F.lit("return").alias("kind"))
            rows = rows.unionByName(back)
        out = rows if out is None else out.unionByName(rows)
        state = level.select("root", F.col("callee").alias("at"), "active", "ord")
    if out is None:
        out = state.select("root", "ord", F.lit(0).alias("depth"), F.col("at").alias("caller"), F.col("at").alias("callee"), F.lit("call").alias("kind")).limit(0)
    return out


def expand_once(calls: dict[str, list[tuple[str, str]]], root: str, inside: set[str], blocked: set[tuple[str, str]], max_depth: int, show_returns: bool = False) -> list[tuple[str, str, str, int, str]]:
    """(caller, callee, label, depth, kind) in pre-order; a message shown before is neither shown nor expanded again."""
    out: list[tuple[str, str, str, int, str]] = []
    seen: set[tuple[str, str, str]] = set()
    work = [("visit", root, 0, (root,), None)]
    while work:
        step, node, depth, path, message = work.pop()
        if step == "back":
            out.append(message)
            continue
        if step == "call":
            callee, label = message
            if (node, callee, label) in seen:
                continue
            seen.add((node, callee, label))
            out.append((node, callee, label, depth, "call"))
            if show_returns:
                work.append(("back", node, depth, path, (callee, node, label, depth, "return")))
            if callee in inside:
                work.append(("visit", callee, depth + 1, (*path, callee), None))
            continue
        if depth < max_depth:
            for callee, label in reversed(calls.get(node, [])):
                if (node, callee) not in blocked and callee not in path:
                    work.append(("call", node, depth, path, (callee, label)))
    return out


def expand(calls: DataFrame, roots: DataFrame, blocked: DataFrame | None = None, max_depth: int = 8, show_returns: bool = False, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """(keys, root, pos, caller, callee, label, depth, kind) with repeats hidden: one grouped call for each graph.

    Hiding changes what is expanded, so the walk of a root is sequential; graphs run in parallel.
    """
    keys = list(keys)
    blocked = calls.select(*keys, "caller", "callee").limit(0) if blocked is None else blocked
    rows = calls.select(*keys, F.lit("call").alias("what"), "caller", "callee", "label", F.col("pos").cast("long").alias("pos")).unionByName(blocked.select(*keys, F.lit("block").alias("what"), "caller", "callee", F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("pos")))
    rows = rows.unionByName(roots.select(*keys, F.lit("root").alias("what"), F.col("node").alias("caller"), F.lit(None).cast("string").alias("callee"), F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("pos")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        made = group[group.what == "call"].sort_values(["caller", "pos"], kind="stable")
        table: dict[str, list[tuple[str, str]]] = {}
        for r in made.itertuples():
            table.setdefault(r.caller, []).append((r.callee, r.label))
        stop = {(r.caller, r.callee) for r in group[group.what == "block"].itertuples()}
        out = [(root, i, *m) for root in sorted(set(group.caller[group.what == "root"])) for i, m in enumerate(expand_once(table, root, set(table), stop, max_depth, show_returns))]
        frame = pd.DataFrame(out, columns=["root", "pos", "caller", "callee", "label", "depth", "kind"])
        for i, k in enumerate(keys):
            frame.insert(i, k, group[k].iloc[0])
        return frame

    shape = ", ".join([*(f"`{k}` {calls.schema[k].dataType.simpleString()}" for k in keys), "root string, pos long, caller string, callee string, label string, depth int, kind string"])
    return rows.groupBy(*keys).applyInPandas(run, shape)


def call_chains(calls: DataFrame, starts: DataFrame, max_depth: int = 5, keys: Sequence[str] = ("graph_id",)) -> DataFrame:
    """(keys, start, pos, node): what each start reaches, in pre-order, each node once, the start left out."""
    if max_depth < 0:
        raise ValueError("max_depth must not be negative")
    keys = list(keys)
    rows = calls.select(*keys, "caller", "callee", F.col("pos").cast("long").alias("pos")).unionByName(starts.select(*keys, F.col("node").alias("caller"), F.lit(None).cast("string").alias("callee"), F.lit(-1).cast("long").alias("pos")))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        table: dict[str, list[str]] = {}
        for r in group[group.pos >= 0].sort_values(["caller", "pos"], kind="stable").itertuples():
            table.setdefault(r.caller, []).append(r.callee)
        out = []
        for start in sorted(set(group.caller[group.pos < 0])):
            seen, work, n = {start}, [(c, 1) for c in reversed(table.get(start, []))] if max_depth else [], 0
            while work:
                node, depth = work.pop()
                if node in seen:
                    continue
                seen.add(node)
                out.append((start, n, node))
                n += 1
                if depth < max_depth:
                    work.extend((c, depth + 1) for c in reversed(table.get(node, [])))
        frame = pd.DataFrame(out, columns=["start", "pos", "node"])
        for i, k in enumerate(keys):
            frame.insert(i, k, group[k].iloc[0])
        return frame

    shape = ", ".join([*(f"`{k}` {calls.schema[k].dataType.simpleString()}" for k in keys), "start string, pos long, node string"])
    return rows.groupBy(*keys).applyInPandas(run, shape)


def number_messages(messages: DataFrame, keys: Sequence[str], order: str = "pos", depth: str = "depth", max_depth: int = 8) -> DataFrame:
    """messages with `number`: hierarchical counters ("1", "2", "2.1"), by windows alone.

    The counter of level d counts rows of depth d since the last row that was less deep;
    a level that was skipped shows 0.
    """
    w = W.partitionBy(*keys).orderBy(order)
    out, levels = messages, []
    for d in range(max_depth + 1):
        reset = F.coalesce(F.sum(F.when(F.col(depth) < d, 1)).over(w), F.lit(0)) if d else F.lit(0)
        out = out.withColumn(f"__r{d}", reset)
        out = out.withColumn(f"__n{d}", F.coalesce(F.sum(F.when(F.col(depth) == d, 1)).over(W.partitionBy(*keys, f"__r{d}").orderBy(order)), F.lit(0)))
        levels.append(F.when(F.col(depth) >= d, F.col(f"__n{d}").cast("string")))
    return out.withColumn("number", F.concat_ws(".", *levels)).select(*messages.columns, "number")


def participants(messages: DataFrame, keys: Sequence[str], order: str = "pos") -> DataFrame:
    """(keys, name, first): names by first appearance, a caller before its callee."""
    ends = messages.select(*keys, F.explode(F.array(F.struct(F.col("caller").alias("name"), F.struct(F.col(order).alias("p"), F.lit(0).alias("side")).alias("at")), F.struct(F.col("callee").alias("name"), F.struct(F.col(order).alias("p"), F.lit(1).alias("side")).alias("at")))).alias("e"))
    return ends.groupBy(*keys, F.col("e.name").alias("name")).agg(F.min("e.at").alias("first"))
