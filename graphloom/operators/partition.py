"""Partition of a relation graph into readable series: hubs out, weak components, recursive split."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .store import saved


def shared_nodes(edges: DataFrame, threshold: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(node): hubs with at least `threshold` distinct callers."""
    return graph.high_fan_in(edges, threshold, keys).select(*keys, "node")


def regular_edges(edges: DataFrame, shared: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Edge rows with no hub at either end."""
    keys = list(keys)
    for end in ("caller", "callee"):
        edges = edges.join(shared.withColumnRenamed("node", end), [*keys, end], "left_anti")
    return edges


def _distances(root: str, out: dict[str, list[str]]) -> dict[str, int]:
    seen, queue = {root: 0}, deque([root])
    while queue:
        node = queue.popleft()
        for nxt in out.get(node, ()):
            if nxt not in seen:
                seen[nxt] = seen[node] + 1
                queue.append(nxt)
    return seen


def split_component(nodes: set[str], rows: list[tuple[str, str]], cyclic: set[str], min_size: int) -> list[tuple[str, int, str | None, list[str]]]:
    """(root, depth, parent root, nodes) of each series of one weak component, parents first.

    A child subgraph is cut off if its forward closure is large enough, proper, free of
    cycles, and entered by exactly one edge row, which comes from a parent with two
    different callees or more.  Candidates are taken by distance of the parent, parent,
    child, larger first, and do not overlap; each is split again one level deeper.
    """
    series = []
    todo = deque([(nodes, None, 0, None)])
    while todo:
        part, given, depth, parent_root = todo.popleft()
        inner = [(a, b) for a, b in rows if a in part and b in part]
        out: dict[str, list[str]] = {}
        entered: dict[str, int] = {}
        for a, b in inner:
            kids = out.setdefault(a, [])
            if b not in kids:
                kids.append(b)
            entered[b] = entered.get(b, 0) + 1
        root = given or min([n for n in part if n not in entered] or part)
        far = _distances(root, out)
        options = []
        for parent, kids in out.items():
            if len(kids) < 2:
                continue
            for child in kids:
                closure = set(_distances(child, out))
                if len(closure) < min_size or closure == part or closure & cyclic:
                    continue
                entrances = [(a, b) for a, b in inner if b in closure and a not in closure]
                if entrances == [(parent, child)]:
                    options.append((far.get(parent, len(part) + 1), parent, child, -len(closure), closure))
        taken: set[str] = set()
        chosen = []
        for _, _, child, _, closure in sorted(options, key=lambda o: o[:4]):
            if not closure & taken:
                taken |= closure
                chosen.append((child, closure))
        series.append((root, depth, parent_root, sorted(part - taken)))
        todo.extendleft((closure, child, depth + 1, root) for child, closure in reversed(chosen))
    return series


def partition(edges: DataFrame, nodes: DataFrame | None = None, threshold: int = 3, min_size: int = 3, keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(series rows (component, series_root, depth, parent_root, node), shared nodes).

    Everything but the split itself is joins and aggregates over all graphs; the split
    is a grouped call for each weak component that has an edge, which its order-bound
    choice needs.  Components of one node never reach Python.
    """
    if min_size < 2:
        raise ValueError("min_size must be at least 2")
    keys = list(keys)
    edges = edges.select(*keys, "caller", "callee")
    hubs = saved(shared_nodes(edges, threshold, keys), "hubs")
    regular = saved(regular_edges(edges, hubs, keys), "regular")
    others = graph.endpoints(edges, nodes, keys).join(hubs, [*keys, "node"], "left_anti")
    comp = saved(graph.weak_components(regular, others, keys), "weak")
    cyclic = graph.cyclic_nodes(edges, graph.strong_components(edges, None, keys), keys).withColumn("cyclic", F.lit(True))
    labelled = regular.join(comp.withColumnRenamed("node", "caller"), [*keys, "caller"])
    for end in ("caller", "callee"):
        labelled = labelled.join(cyclic.withColumnRenamed("node", end).withColumnRenamed("cyclic", f"y_{end}"), [*keys, end], "left")
    kinds = [*(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys), "component string, series_root string, depth int, parent_root string, node string"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(rows["caller"], rows["callee"], strict=True))
        loops = {n for end in ("caller", "callee") for n, y in zip(rows[end], rows[f"y_{end}"], strict=True) if y is True}
        found = split_component({n for p in pairs for n in p}, pairs, loops, min_size)
        out = [(rows["component"].iloc[0], root, depth, parent, n) for root, depth, parent, members in found for n in members]
        frame = pd.DataFrame(out, columns=["component", "series_root", "depth", "parent_root", "node"])
        for i, k in enumerate(keys):
            frame.insert(i, k, rows[k].iloc[0])
        return frame

    split = labelled.groupBy(*keys, "component").applyInPandas(run, ", ".join(kinds))
    alone = comp.join(graph.endpoints(regular, None, keys), [*keys, "node"], "left_anti")
    single = alone.select(*keys, "component", F.col("node").alias("series_root"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_root"), "node")
    return split.unionByName(single), hubs


def statistics(edges: DataFrame, nodes: DataFrame | None, series: DataFrame, hubs: DataFrame) -> DataFrame:
    """The metrics of one graph's partition, as (metric, value)."""
    own = series.select("node", F.col("series_root").alias("s"))
    regular = regular_edges(edges, hubs)
    crossing = regular.join(own.select(F.col("node").alias("caller"), F.col("s").alias("a")), "caller").join(own.select(F.col("node").alias("callee"), F.col("s").alias("b")), "callee")
    e = crossing.agg(F.count("*").alias("regular"), F.count_if(F.col("a") != F.col("b")).alias("cross"))
    s = series.groupBy("series_root").agg(F.count("*").alias("n"), F.max("depth").alias("d")).agg(F.count("*").alias("series"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("d"), F.lit(0)).alias("deep"), F.coalesce(F.sum("n"), F.lit(0)).alias("placed"))
    h = hubs.agg(F.count("*").alias("shared"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    total = F.col("placed") + F.col("shared")
    values = {
        "shared_node_count": F.col("shared"), "series_count": F.col("series"), "max_nodes_per_series": F.col("largest"), "average_nodes_per_series": F.col("mean"), "max_depth": F.col("deep"),
        "regular_edge_count": F.col("regular"), "cross_series_edge_count": F.col("cross"), "cross_series_ratio": ratio(F.col("cross"), F.col("regular")), "total_node_count": total, "shared_ratio": ratio(F.col("shared"), total),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()))
    return e.crossJoin(F.broadcast(s)).crossJoin(F.broadcast(h)).select(F.inline(rows))
