"""Reference resolution: names as written to the entities they mean, by joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names


def _unique_tail(known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(simple, target) for last segments that only one known name has."""
    return known.select(*keys, names.last_segment("name").alias("simple"), "name").distinct().groupBy(*keys, "simple").agg(F.min("name").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")


def resolve_calls(calls: DataFrame, known: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """calls (raw, parent, ...) with `target`: the exact name; else self./cls. in the parent; else a unique simple name; else the raw text."""
    keys = list(keys)
    full = known.select(*keys, "name").distinct()
    exact = full.select(*keys, F.col("name").alias("raw"), F.col("name").alias("t1"))
    own = full.select(*keys, F.col("name").alias("own"), F.col("name").alias("t2"))
    simple = _unique_tail(known, keys).select(*keys, F.col("simple").alias("raw"), F.col("target").alias("t3"))
    tail = F.regexp_extract("raw", r"^(?:self|cls)\.(.+)$", 1)
    asked = calls.withColumn("own", F.when((tail != "") & (F.coalesce(F.col("parent"), F.lit("")) != ""), F.concat("parent", F.lit("."), tail)))
    out = asked.join(exact, [*keys, "raw"], "left").join(own, [*keys, "own"], "left").join(simple, [*keys, "raw"], "left")
    plain = F.when(~F.col("raw").contains("."), F.col("t3"))
    return out.withColumn("target", F.coalesce("t1", "t2", plain, "raw")).select(*calls.columns, "target")


def _prefixes(refs: DataFrame, column: str) -> DataFrame:
    parts = F.split(column, r"\.")
    return refs.withColumn("__end", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("__prefix", F.array_join(F.slice(parts, F.lit(1), F.col("__end")), "."))


def longest_prefix(refs: DataFrame, known: DataFrame, column: str = "ref", keys: Sequence[str] = ()) -> DataFrame:
    """refs with `target`: the longest dotted prefix that is a known name, or null.

    Prefixes are rows, so the match is an equi-join; the best is kept by an aggregate
    over the distinct references only.
    """
    keys = list(keys)
    asked = _prefixes(refs.select(*keys, column).distinct(), column)
    hit = asked.join(known.select(*keys, F.col("name").alias("__prefix")).distinct(), [*keys, "__prefix"])
    best = hit.groupBy(*keys, column).agg(F.max_by("__prefix", "__end").alias("target"))
    return refs.join(best, [*keys, column], "left")


def resolve_classes(refs: DataFrame, known: DataFrame, column: str = "ref", keys: Sequence[str] = ()) -> DataFrame:
    """refs with `target`: from the longest prefix down, the exact class, else a unique class with the prefix's last segment."""
    keys = list(keys)
    asked = _prefixes(refs.select(*keys, column).distinct(), column).withColumn("__simple", names.last_segment("__prefix"))
    exact = asked.join(known.select(*keys, F.col("name").alias("__prefix")).distinct(), [*keys, "__prefix"]).select(*keys, column, F.col("__prefix").alias("t"), (-2 * F.col("__end")).alias("rank"))
    simple = asked.join(_unique_tail(known, keys).withColumnRenamed("simple", "__simple"), [*keys, "__simple"]).select(*keys, column, F.col("target").alias("t"), (1 - 2 * F.col("__end")).alias("rank"))
    best = exact.unionByName(simple).groupBy(*keys, column).agg(F.min_by("t", "rank").alias("target"))
    return refs.join(best, [*keys, column], "left")


def resolve_objects(refs: DataFrame, objects: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """refs (scope, name, ...) with `target`: the object of that name in the same scope (null is a scope), else a unique one; others go."""
    keys = list(keys)
    known = objects.select(*keys, "scope", "name").distinct()
    same = known.select(*keys, F.coalesce("scope", F.lit("<module>")).alias("__scope"), "name", names.object_key("scope", "name").alias("t1"))
    lone = known.groupBy(*keys, "name").agg(F.count("*").alias("n"), F.min(names.object_key("scope", "name")).alias("t2")).where("n = 1").drop("n")
    asked = refs.withColumn("__scope", F.coalesce("scope", F.lit("<module>")))
    out = asked.join(same, [*keys, "__scope", "name"], "left").join(lone, [*keys, "name"], "left").withColumn("target", F.coalesce("t1", "t2"))
    return out.where("target is not null").select(*refs.columns, "target")


def package_edges(imports: DataFrame, units: DataFrame) -> DataFrame:
    """(caller, callee): imports (module, ref) resolved against units (name, is_package), self-references left out."""
    rel = imports.join(units.select(F.col("name").alias("module"), "is_package"), "module").withColumn("full", F.when(F.col("ref").startswith("."), names.resolve_relative("module", "is_package", "ref")).otherwise(F.col("ref")))
    found = longest_prefix(rel, units.select("name"), "full")
    return found.where("target is not null and target != module").select(F.col("module").alias("caller"), F.col("target").alias("callee")).distinct()


def component_edges(imports: DataFrame, units: DataFrame) -> DataFrame:
    """Imports lifted to components (units: name, is_package, component); what resolves to none becomes external:head."""
    place = units.select("name", "component").distinct()
    rel = imports.join(units.select(F.col("name").alias("module"), "is_package", F.col("component").alias("caller")), "module").withColumn("full", F.when(F.col("ref").startswith("."), names.resolve_relative("module", "is_package", "ref")).otherwise(F.col("ref")))
    found = longest_prefix(rel, units.select("name"), "full").join(place.select(F.col("name").alias("target"), F.col("component").alias("inner")), "target", "left")
    head = F.split("ref", r"\.")[0]
    outer = found.where("inner is null and not startswith(ref, '.')").withColumn("head", head).join(place.select(F.split("component", r"\.")[0].alias("head")).distinct(), "head", "left_anti").select("caller", F.concat(F.lit("external:"), "head").alias("callee"))
    return found.where("inner is not null and inner != caller").select("caller", F.col("inner").alias("callee")).unionByName(outer).distinct()


def selector_matches(selectors: DataFrame, labels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(selector, target) where all pairs of a selector (selector, k, v) are among a target's labels (target, k, v).

    Containment as an equi-join on pairs and a count; an empty selector has no rows and matches nothing.
    """
    keys = list(keys)
    pairs = selectors.select(*keys, "selector", "k", "v").distinct()
    need = pairs.groupBy(*keys, "selector").agg(F.count("*").alias("need"))
    got = pairs.join(labels.select(*keys, "target", "k", "v").distinct(), [*keys, "k", "v"]).groupBy(*keys, "selector", "target").agg(F.count("*").alias("got"))
    return got.join(need, [*keys, "selector"]).where("got = need").select(*keys, "selector", "target")
