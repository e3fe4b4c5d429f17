"""Diagram bundles: a partitioned graph as one diagram for each series and each hub, rendered and placed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import partition, resolve, sequence
from ..operators.store import saved
from . import render

#: kind: (edges that a series shows, edges that a hub shows).
RULES = {
    "call_graph": ("boundary", "incident"),
    "class_diagram": ("inside", "incoming"),
    "object_diagram": ("inside", "incident"),
    "package_diagram": ("inside", "incident"),
    "component_diagram": ("inside", "incident"),
    "deployment_diagram": ("inside", "incident"),
}


def series_edges(edges: DataFrame, series: DataFrame, hubs: DataFrame, rule: str) -> DataFrame:
    """Edges by diagram (series_root): both ends in the series, or (`boundary`) the caller in it and the callee no hub."""
    own = series.select("node", F.col("series_root").alias("diagram"))
    kept = edges.join(own.withColumnRenamed("node", "caller"), "caller").join(hubs.select(F.col("node").alias("callee")), "callee", "left_anti")
    if rule == "inside":
        kept = kept.join(own.select(F.col("node").alias("callee"), F.col("diagram").alias("other")), "callee").where("diagram = other").drop("other")
    return kept.select("diagram", *edges.columns)


def hub_edges(edges: DataFrame, hubs: DataFrame, rule: str) -> DataFrame:
    """Edges by diagram (the hub): those into it, or (`incident`) also those out of it."""
    incoming = edges.join(hubs.select(F.col("node").alias("callee")), "callee", "left_semi").select(F.col("callee").alias("diagram"), *edges.columns)
    if rule == "incoming":
        return incoming
    outgoing = edges.where("caller != callee").join(hubs.select(F.col("node").alias("caller")), "caller", "left_semi").select(F.col("caller").alias("diagram"), *edges.columns)
    return incoming.unionByName(outgoing)


def bundle(edges: DataFrame, nodes: DataFrame | None = None, kind: str = "call_graph", threshold: int = 3, min_size: int = 3) -> DataFrame:
    """(kind, diagram, shared, depth, parent_root, relative_dir, name, content): one row for each diagram of a graph."""
    series_rule, hub_rule = RULES[kind]
    edges = saved(edges.select("caller", "callee").distinct(), "bundle")
    series, hubs = partition.partition(edges, nodes, threshold, min_size)
    series = saved(series, "series")
    regular = render.call_graph(series_edges(edges, series, hubs, series_rule), series.select(F.col("series_root").alias("diagram"), "node"), ["diagram"])
    hub = render.call_graph(hub_edges(edges, hubs, hub_rule), hubs.select(F.col("node").alias("diagram"), "node"), ["diagram"])
    return _placed(kind, regular, hub, series)


def _placed(kind: str, regular: DataFrame, hub: DataFrame, series: DataFrame) -> DataFrame:
    """The bundle's rows from the contents of its series and hubs."""
    placed = regular.join(series.select(F.col("series_root").alias("diagram"), "depth", "parent_root").distinct(), "diagram").withColumn("shared", F.lit(False)).withColumn("relative_dir", names.series_directory("diagram"))
    shared = hub.select("diagram", "content", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_root"), F.lit(True).alias("shared"), F.lit("shared").alias("relative_dir"))
    return placed.unionByName(shared).select(F.lit(kind).alias("kind"), "diagram", "shared", "depth", "parent_root", "relative_dir", names.stable_output_name(kind, "diagram").alias("name"), "content")


def raw_call_edges(entities: DataFrame, keys: Sequence[str] = ("module_id",)) -> DataFrame:
    """Unresolved call edges of callables, one for each entity and distinct call."""
    return entities.where("kind != 'class'").select(*keys, F.col("qname").alias("caller"), F.explode("calls").alias("callee"))


def latest_entities(entities: DataFrame, keys: Sequence[str] = ("module_id",)) -> DataFrame:
    """One entity for each qualified name: a redefinition replaces what was before."""
    rest = [c for c in entities.columns if c not in (*keys, "qname")]
    picked = entities.groupBy(*keys, "qname").agg(F.max_by(F.struct(*rest), "ordinal").alias("e"))
    return picked.select(*keys, "qname", *(F.col(f"e.`{c}`").alias(c) for c in rest)).select(*entities.columns)


def sequence_graph(entities: DataFrame, keys: Sequence[str] = ("module_id",)) -> DataFrame:
    """(keys, caller, pos, raw, callee): calls resolved to callables of the module, in order; others are left out."""
    keys = list(keys)
    functions = latest_entities(entities, keys).where("kind != 'class'")
    known = functions.select(*keys, F.col("qname").alias("name"))
    calls = functions.select(*keys, F.col("qname").alias("caller"), "parent", F.posexplode("call_sequence").alias("pos", "raw"))
    found = resolve.resolve_calls(calls, known, keys)
    return found.join(known.withColumnRenamed("name", "target"), [*keys, "target"], "left_semi").select(*keys, "caller", "pos", "raw", F.col("target").alias("callee"))


def class_graph(entities: DataFrame, keys: Sequence[str] = ("module_id",)) -> DataFrame:
    """(keys, caller, callee, relation): inheritance (unknown bases as written) and uses by methods of known classes; no self-edges."""
    keys = list(keys)
    latest = latest_entities(entities, keys)
    classes = latest.where("kind = 'class'")
    known = classes.select(*keys, F.col("qname").alias("name"))
    bases = resolve.resolve_classes(classes.select(*keys, F.col("qname").alias("caller"), F.explode("bases").alias("ref")), known, "ref", keys)
    inherits = bases.select(*keys, "caller", F.coalesce("target", "ref").alias("callee"), F.lit("inheritance").alias("relation"))
    methods = latest.where("kind = 'method'").join(known.select(*keys, F.col("name").alias("parent")), [*keys, "parent"], "left_semi")
    used = resolve.resolve_classes(methods.select(*keys, F.col("parent").alias("caller"), F.explode("calls").alias("ref")), known, "ref", keys)
    uses = used.where("target is not null").select(*keys, "caller", F.col("target").alias("callee"), F.lit("uses").alias("relation"))
    return inherits.unionByName(uses).where("caller != callee").distinct()


def class_diagrams(entities: DataFrame, threshold: int = 3, min_size: int = 3, plantuml: bool = False) -> DataFrame:
    """The class diagrams of one module, as `bundle`: classes with their methods, inheritance and uses; bases from elsewhere are external.

    A pair that both inherits and uses counts as two edges where the partition counts rows.
    """
    series_rule, hub_rule = RULES["class_diagram"]
    edges = saved(class_graph(entities, ()), "classes")
    latest = latest_entities(entities, ())
    known = latest.where("kind = 'class'").select(F.col("qname").alias("name"), F.lit(False).alias("external"))
    series, hubs = partition.partition(edges, known.select(F.col("name").alias("node")), threshold, min_size)
    series = saved(series, "series")
    methods = latest.where("kind = 'method'").select(F.col("parent").alias("name"), F.col("name").alias("member"), "visibility", F.col("ordinal").alias("pos"))

    def drawn(nodes: DataFrame, relations: DataFrame) -> DataFrame:
        classes = nodes.join(known, "name", "left").select("diagram", "name", F.coalesce("external", F.lit(True)).alias("external"))
        members = methods.join(classes.where("not external").select("diagram", "name"), "name")
        return render.class_diagram(classes, members, relations, plantuml, ["diagram"])

    regular = drawn(series.select(F.col("series_root").alias("diagram"), F.col("node").alias("name")), series_edges(edges, series, hubs, series_rule))
    incoming = hub_edges(edges, hubs, hub_rule)
    around = hubs.select(F.col("node").alias("diagram"), F.col("node").alias("name")).unionByName(incoming.select("diagram", F.col("caller").alias("name"))).distinct()
    return _placed("class_diagram", regular, drawn(around, incoming), series)


def responsibilities(entities: DataFrame, keys: Sequence[str] = ("module_id",)) -> DataFrame:
    """(keys, class_name, responsibility): by docstring or the family of the methods."""
    keys = list(keys)
    latest = latest_entities(entities, keys)
    methods = latest.where("kind = 'method'").groupBy(*keys, F.col("parent").alias("qname")).agg(F.collect_set(F.lower("name")).alias("m"))
    rows = latest.where("kind = 'class'").join(methods, [*keys, "qname"], "left").withColumn("m", F.coalesce("m", F.array().cast("array<string>")))
    return rows.select(*keys, F.col("qname").alias("class_name"), names.responsibility("name", "docstring", "m").alias("responsibility"))


def sequence_diagrams(entities: DataFrame, max_depth: int = 8, show_returns: bool = False, keys: Sequence[str] = ("module_id",)) -> DataFrame:
    """(keys, root, content): a Mermaid sequence diagram for each callable that nobody of the module calls, repeats hidden."""
    keys = list(keys)
    calls = saved(sequence_graph(entities, keys), "calls")
    roots = calls.select(*keys, F.col("caller").alias("node")).distinct().join(calls.select(*keys, F.col("callee").alias("node")), [*keys, "node"], "left_anti")
    messages = saved(sequence.expand(calls.withColumn("label", names.last_segment("raw")), roots, None, max_depth, show_returns, keys), "messages")
    found = sequence.participants(messages, [*keys, "root"])
    from pyspark.sql import Window as W

    ranked = found.withColumn("pos", F.row_number().over(W.partitionBy(*keys, "root").orderBy("first")) - 1)
    return render.sequence_diagram(messages, ranked, [*keys, "root"])
