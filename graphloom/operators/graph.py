"""Relation graphs as edge tables (caller, callee, ...) and node tables (node).

`keys` names columns that tell graphs apart, so one job answers for many graphs.
Counts use distinct neighbours; edge tables may hold several rows for a pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

#: Edges up to which strong components are found in one grouped call; beyond it the distributed loop runs.
SMALL_EDGES = 200_000


def endpoints(edges: DataFrame, nodes: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """All nodes: the ends of edges and the explicit ones."""
    both = edges.select(*keys, F.explode(F.array("caller", "callee")).alias("node"))
    return (both if nodes is None else both.unionByName(nodes.select(*keys, "node"))).distinct()


def _degree(edges: DataFrame, side: str, other: str, nodes: DataFrame | None, keys: Sequence[str], name: str) -> DataFrame:
    all_nodes = endpoints(edges, nodes, keys)
    counts = edges.select(*keys, side, other).distinct().groupBy(*keys, F.col(side).alias("node")).agg(F.count("*").alias(name))
    return all_nodes.join(counts, [*keys, "node"], "left").fillna(0, [name])


def fan_in(edges: DataFrame, nodes: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(node, fan_in): distinct callers of every node, 0 included."""
    return _degree(edges, "callee", "caller", nodes, keys, "fan_in")


def fan_out(edges: DataFrame, nodes: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    return _degree(edges, "caller", "callee", nodes, keys, "fan_out")


def high_fan_in(edges: DataFrame, threshold: int, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes with at least `threshold` distinct callers; no zero rows are made."""
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    pairs = edges.select(*keys, "caller", "callee").distinct()
    return pairs.groupBy(*keys, F.col("callee").alias("node")).agg(F.count("*").alias("fan_in")).where(F.col("fan_in") >= threshold)


def high_fan_out(edges: DataFrame, threshold: int, keys: Sequence[str] = ()) -> DataFrame:
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    pairs = edges.select(*keys, "caller", "callee").distinct()
    return pairs.groupBy(*keys, F.col("caller").alias("node")).agg(F.count("*").alias("fan_out")).where(F.col("fan_out") >= threshold)


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("caller") == node)


def incoming(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("callee") == node)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Ordered distinct: of the rows with equal keys, the first in `order`.  One aggregate with map-side combine, no window."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *(F.col(f"__row.`{c}`").alias(c) for c in rest)).select(*df.columns)


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(node, depth) within max_depth steps of the roots (`node`), each with its smallest depth; roots have 0.

    Frontier rounds: join, distinct, anti-join with what was visited.  Each round is
    materialised, so a deep graph has a short plan.
    """
    if max_depth is not None and max_depth < 0:
        raise ValueError("max_depth must not be negative")
    hop = edges.select(*keys, "caller", "callee").distinct()
    seen = saved(roots.select(*keys, "node").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.select(*keys, F.col("node").alias("caller")).join(hop, [*keys, "caller"]).select(*keys, F.col("callee").alias("node")).distinct()
        frontier = saved(step.join(seen, [*keys, "node"], "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def reachable_edges(edges: DataFrame, reached: DataFrame, max_depth: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """The distinct edges a bounded search crosses: those whose caller lies above the bound."""
    callers = reached if max_depth is None else reached.where(F.col("depth") < max_depth)
    return edges.select(*keys, "caller", "callee").distinct().join(callers.select(*keys, F.col("node").alias("caller")), [*keys, "caller"], "left_semi")


def _star_round(edges: DataFrame, keys: list[str]) -> DataFrame:
    """A large-star and a small-star round on edges (u, v), u > v."""
    flip = edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
    both = edges.unionByName(flip)
    low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.where("v > u").join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    small = large.join(low, [*keys, "u"]).where("v != m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select(*keys, "u", F.col("m").alias("v"))).distinct()


def _united(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(node, component) by union-find in one grouped call for each graph; pairs (u, v) are few."""
    kind = pairs.schema["u"].dataType.simpleString()
    shape = ", ".join([*(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys), f"node {kind}, component {kind}"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        top: dict = {}

        def find(n):
            while top.setdefault(n, n) != n:
                top[n] = n = top[top[n]]
            return n

        for u, v in zip(rows["u"], rows["v"], strict=True):
            a, b = find(u), find(v)
            top[max(a, b)] = min(a, b)
        return pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "node": list(top), "component": [find(n) for n in list(top)]})

    return pairs.withColumn("__all", F.lit(1)).groupBy(*keys, "__all").applyInPandas(run, shape)


def weak_components(edges: DataFrame, nodes: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(node, component): the smallest node that is connected, directions aside.

    Up to SMALL_EDGES distinct edges by union-find in a grouped call, beyond that by star contraction.
    """
    keys = list(keys)
    pairs = edges.where("caller != callee").select(*keys, F.greatest("caller", "callee").alias("u"), F.least("caller", "callee").alias("v"))
    held, state = saved(pairs.distinct(), "weak"), None
    small = held.count() <= SMALL_EDGES
    while not small:
        held = saved(_star_round(held, keys), "weak")
        now = held.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    linked = _united(held, keys) if small else held.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    return endpoints(edges, nodes, keys).join(linked, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def tarjan(nodes: list, pairs: list[tuple]) -> dict:
    """node -> smallest member of its strong component; iterative, so depth is no limit."""
    out: dict = {n: [] for n in nodes}
    for a, b in pairs:
        out[a].append(b)
    index: dict = {}
    low: dict = {}
    stack, on, result = [], set(), {}
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    result.update(dict.fromkeys(members, min(members)))
    return result


def _spread_min(labels: DataFrame, hop: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest label that reaches each node along hop (caller -> callee), to the fixed point."""
    while True:
        got = labels.join(hop, F.col("node") == F.col("caller")).select(*[labels[k] for k in keys], F.col("callee").alias("node"), "label") if not keys else labels.withColumnRenamed("node", "caller").join(hop, [*keys, "caller"]).select(*keys, F.col("callee").alias("node"), "label")
        new = saved(labels.unionByName(got).groupBy(*keys, "node").agg(F.min("label").alias("label")), "labels")
        if new.join(labels, [*keys, "node", "label"], "left_anti").isEmpty():
            return new
        labels = new


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(node, component): the smallest node that reaches and is reached.

    Up to SMALL_EDGES distinct edges a grouped call finds them; beyond that, rounds of
    trimming (nodes without callers or callees are alone), forward smallest-label
    colouring, and backward confirmation inside each colour.
    """
    keys = list(keys)
    hop = saved(edges.select(*keys, "caller", "callee").distinct(), "strong")
    everything = endpoints(hop, nodes, keys)
    if hop.count() <= SMALL_EDGES:
        kind = hop.schema["caller"].dataType.simpleString()
        shape = ", ".join([*(f"`{k}` {hop.schema[k].dataType.simpleString()}" for k in keys), f"node {kind}, component {kind}"])

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            pairs = list(zip(rows["caller"], rows["callee"], strict=True))
            found = tarjan(list(dict.fromkeys([*rows["caller"], *rows["callee"]])), pairs)
            return pd.DataFrame({**{k: rows[k].iloc[0] for k in keys}, "node": list(found), "component": list(found.values())})

        linked = hop.withColumn("__all", F.lit(1)).groupBy(*keys, "__all").applyInPandas(run, shape)
    else:
        linked = _strong_loop(hop, keys)
    return everything.join(linked, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def _strong_loop(hop: DataFrame, keys: list[str]) -> DataFrame:
    done = None
    while True:
        while True:  # trim
            inner = hop.join(hop.select(*keys, F.col("callee").alias("caller")).distinct(), [*keys, "caller"], "left_semi")
            inner = saved(inner.join(hop.select(*keys, F.col("caller").alias("callee")).distinct(), [*keys, "callee"], "left_semi").select(*keys, "caller", "callee"), "strong")
            if inner.count() == hop.count():
                break
            hop = inner
        if hop.isEmpty():
            break
        start = endpoints(hop, None, keys).withColumn("label", F.col("node"))
        color = _spread_min(start, hop, keys)
        ends = [color.select(*keys, F.col("node").alias(c), F.col("label").alias(f"l_{c}")) for c in ("caller", "callee")]
        same = hop.join(ends[0], [*keys, "caller"]).join(ends[1], [*keys, "callee"]).where("l_caller = l_callee")
        back = saved(same.select(*keys, F.col("callee").alias("caller"), F.col("caller").alias("callee")), "strong")
        roots = color.where("node = label").withColumn("label", F.col("node"))
        confirmed = _spread_min(roots, back, keys).select(*keys, "node", F.col("label").alias("component"))
        done = confirmed if done is None else done.unionByName(confirmed)
        gone = confirmed.select(*keys, "node")
        hop = saved(hop.join(gone.withColumnRenamed("node", "caller"), [*keys, "caller"], "left_anti").join(gone.withColumnRenamed("node", "callee"), [*keys, "callee"], "left_anti").select(*keys, "caller", "callee"), "strong")
    if done is None:
        return hop.select(*keys, F.col("caller").alias("node"), F.col("callee").alias("component"))
    return done


def cyclic_nodes(edges: DataFrame, components: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes on any cycle: strong components with several members, and self-calls."""
    keys = list(keys)
    large = components.groupBy(*keys, "component").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    loops = edges.where("caller = callee").select(*keys, F.col("caller").alias("node")).distinct()
    return components.join(large, [*keys, "component"], "left_semi").select(*keys, "node").unionByName(loops).distinct()


def cycle_edges(edges: DataFrame, components: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edges that lie on a cycle: both ends in one strong component.  Nothing is enumerated."""
    keys = list(keys)
    a, b = (components.select(*keys, F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("caller", "callee"))
    return edges.join(a, [*keys, "caller"]).join(b, [*keys, "callee"]).where("c_caller = c_callee").drop("c_caller", "c_callee").select(*edges.columns)


def elementary_cycles(edges: DataFrame, max_paths: int = 5_000_000) -> DataFrame:
    """(path): every elementary cycle once, from its smallest node, closed.

    Paths grow inside strong components only and never below their first node.  The
    number of cycles may be exponential: more than max_paths open paths raise an error
    instead of giving a part of the answer.
    """
    hop = edges.select("caller", "callee").distinct()
    inside = saved(cycle_edges(hop, strong_components(hop)), "cycle-edges")
    paths = inside.where("callee >= caller").select(F.col("caller").alias("first"), F.col("callee").alias("last"), F.array("caller").alias("path"))
    found = None
    while True:
        paths = saved(paths, "paths")
        closed = paths.where("last = first").select(F.array_append("path", F.col("first")).alias("path"))
        found = closed if found is None else found.unionByName(closed)
        live = paths.where("last != first")
        n = live.count()
        if not n:
            return found
        if n > max_paths:
            raise ValueError(f"more than {max_paths} open paths")
        grown = live.select("first", F.col("last").alias("caller"), F.array_append("path", F.col("last")).alias("path")).join(inside, "caller")
        paths = grown.where("callee = first or (callee > first and not array_contains(path, callee))").select("first", F.col("callee").alias("last"), "path")
