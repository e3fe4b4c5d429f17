"""Facts of CI workflows, compose files and Kubernetes manifests as rows.

YAML needs a parser, so each document family is one mapped pass; what follows (routing,
path hints, references, rules) is joins and column expressions.  Expressions in
workflows are never evaluated, and values of environment variables are never kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import resolve

# Fixed values of the manifest rules.
WORKLOADS = {"Deployment", "StatefulSet", "DaemonSet", "Pod", "Job", "CronJob"}
CACHE_ACTIONS = {"actions/cache": "cache", "actions/cache/restore": "cache-restore", "actions/cache/save": "cache-save", "actions/upload-artifact": "artifact-upload", "actions/download-artifact": "artifact-download"}


def as_map(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def as_text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def as_list(value: object) -> list[str]:
    """A string, a list's items or a map's keys as strings."""
    if isinstance(value, str):
        return [value]
    return [str(v) for v in value] if isinstance(value, (list, dict)) else []


def tagged(value: object) -> tuple[str, str] | None:
    """A primitive with its type, so that "3.11" and 3.11 differ."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return type(value).__name__, json.dumps(value) if not isinstance(value, str) else value
    return None


def _run(sources: DataFrame, fn, shape: str) -> DataFrame:
    columns = [c.strip().split(" ")[0] for c in shape.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, source in zip(batch["module_id"], batch["source"], strict=True):
                try:
                    rows += [(path, *r, None) for r in fn(path, source or "")]
                except (yaml.YAMLError, ValueError, RecursionError) as e:
                    rows.append((path, *[None] * len(columns), str(e).split("\n")[0]))
            frame = pd.DataFrame(rows, columns=["module_id", *columns, "error"])
            yield frame.astype(object).where(frame.notna(), None)

    return sources.select("module_id", "source").mapInPandas(run, f"module_id string, {shape}, error string")


# --- CI ------------------------------------------------------------------------------------------------------------

STEPS = "job string, pos int, name string, command string, action string, condition string, working_directory string, env_names array<string>, resource_kind string, resource_key string, resource_paths array<string>, flat string"
JOBS = "job string, ord int, runs_on string, needs array<string>, condition string, matrix array<struct<axis:string,type:string,value:string>>, fail_fast string, flat string"


def _workflow(source: str) -> dict:
    root = yaml.safe_load(source)
    if root is None:
        return {}
    if not isinstance(root, dict) or not isinstance(root.get("jobs") or {}, dict):
        raise ValueError("a workflow and its jobs must be mappings")
    return root


def _flat(value: object, leave: str = "") -> str:
    """All scalars below a value as lines, to look for references; the key `leave` is skipped."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo += [x for k, x in v.items() if k != leave]
        elif isinstance(v, list):
            todo += v
        elif v is not None:
            out.append(str(v))
    return "\n".join(out)


def _jobs(path: str, source: str) -> Iterator[tuple]:
    for i, (name, job) in enumerate(as_map(_workflow(source).get("jobs")).items()):
        job = as_map(job)
        strategy = as_map(job.get("strategy"))
        axes = [(str(k), *t) for k, v in as_map(strategy.get("matrix")).items() if k not in ("include", "exclude") and isinstance(v, list) for x in v if (t := tagged(x))]
        fast = strategy.get("fail-fast")
        yield str(name), i, ", ".join(as_list(job.get("runs-on"))) or None, as_list(job.get("needs")), as_text(job.get("if")), axes, None if fast is None else str(fast).lower(), _flat(job, "steps")


def _steps(path: str, source: str) -> Iterator[tuple]:
    for name, job in as_map(_workflow(source).get("jobs")).items():
        job = as_map(job)
        folder = as_text(as_map(as_map(job.get("defaults")).get("run")).get("working-directory"))
        pos = 0
        for step in job.get("steps") or []:
            step = as_map(step)
            command, action = as_text(step.get("run")), as_text(step.get("uses"))
            if not command and not action:
                continue
            given = as_map(step.get("with"))
            kind = CACHE_ACTIONS.get((action or "").lower().split("@", 1)[0])
            paths = given.get("path")
            paths = [p.strip() for p in paths.split("\n") if p.strip()] if isinstance(paths, str) else as_list(paths)
            yield str(name), pos, as_text(step.get("name")) or command or action, command, action, as_text(step.get("if")), as_text(step.get("working-directory")) or folder, [str(k) for k in as_map(step.get("env"))], kind, as_text(given.get("key")) or as_text(given.get("name")) if kind else None, paths if kind else [], _flat(step)
            pos += 1


def ci_jobs(sources: DataFrame) -> DataFrame:
    jobs = _run(sources, _jobs, JOBS)
    return jobs.withColumn("env_refs", names.references("flat", "env")).withColumn("secret_refs", names.references("flat", "secrets")).drop("flat")


def ci_steps(sources: DataFrame) -> DataFrame:
    """Steps with references and path hints: the working folder, a local action, then the command's paths."""
    steps = _run(sources, _steps, STEPS)
    own = F.filter(F.array(F.regexp_replace("working_directory", r"^\./|/+$", ""), F.when(F.col("action").startswith("./"), F.regexp_replace("action", r"^\./|/+$", ""))), lambda p: p.isNotNull())
    hints = F.array_distinct(F.concat(own, F.coalesce(names.command_paths("command"), F.array().cast("array<string>"))))
    return steps.withColumn("env_refs", names.references("flat", "env")).withColumn("secret_refs", names.references("flat", "secrets")).withColumn("path_hints", hints).drop("flat")


# --- deployment ----------------------------------------------------------------------------------------------------

FACTS = "row string, id string, label string, kind string, confidence string, environment string, target string, k string, v string"


def _compose(path: str, source: str) -> Iterator[tuple]:
    root = next(iter(yaml.safe_load_all(source)), None)
    services = as_map(as_map(root).get("services"))
    for name, body in services.items():
        body = as_map(body)
        image = str(body.get("image") or "")
        yield "node", f"service:{name}", str(name), image, "confirmed", "compose", None, "image", image
        for port in body.get("ports") or []:
            yield "port", f"service:{name}", None, None, None, None, None, "port", str(port)
        for other in as_list(body.get("depends_on")):
            if other in services:
                yield "edge", f"service:{name}", None, "depends_on", "confirmed", None, f"service:{other}", None, None
        for other in as_list(body.get("links")):
            if other.split(":")[0] in services:
                yield "edge", f"service:{name}", None, "links", "confirmed", None, f"service:{other.split(':')[0]}", None, None


def compose(sources: DataFrame) -> DataFrame:
    """Node, port and edge rows; a node's kind is classified from its name and image."""
    rows = _run(sources, _compose, FACTS)
    return rows.withColumn("kind", F.when(F.col("row") == "node", names.classify_service("label", "v")).otherwise(F.col("kind")))


def _kubernetes(path: str, source: str) -> Iterator[tuple]:
    for doc in yaml.safe_load_all(source):
        doc = as_map(doc)
        kind, name, spec = str(doc.get("kind", "")), as_map(doc.get("metadata")).get("name"), as_map(doc.get("spec"))
        if not name:
            continue
        node = f"k8s:{kind.lower()}:{name}"
        if kind in WORKLOADS:
            template = spec.get("template") if isinstance(spec.get("template"), dict) else doc
            pod = template.get("spec") if isinstance(template.get("spec"), dict) else spec
            images = [str(c["image"]) for c in pod.get("containers") or [] if isinstance(c, dict) and c.get("image")]
            yield "node", node, str(name), "workload", "confirmed", "kubernetes", None, "images", ", ".join(images)
            for k, v in as_map(as_map(template.get("metadata")).get("labels")).items():
                yield "label", node, None, None, None, None, None, str(k), str(v)
        elif kind == "Service":
            yield "node", node, str(name), "service-endpoint", "confirmed", "kubernetes", None, None, None
            for k, v in as_map(spec.get("selector")).items():
                yield "selector", node, None, None, None, None, None, str(k), str(v)
        elif kind == "Ingress":
            yield "node", node, str(name), "ingress", "confirmed", "kubernetes", None, None, None
            todo, seen = [spec], set()
            while todo:
                v = todo.pop()
                if isinstance(v, dict):
                    service = as_map(v.get("service")).get("name") or v.get("serviceName")
                    if service:
                        seen.add(str(service))
                    todo += list(v.values())
                elif isinstance(v, list):
                    todo += v
            for service in sorted(seen):
                yield "route", node, None, None, None, None, f"k8s:service:{service}", None, None


def kubernetes(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): services route to workloads whose labels contain the selector, ingresses to services of the same file."""
    rows = _run(sources, _kubernetes, FACTS)
    selectors = rows.where("row = 'selector'").select("module_id", F.col("id").alias("selector"), "k", "v")
    labels = rows.where("row = 'label'").select("module_id", F.col("id").alias("target"), "k", "v")
    routes = resolve.selector_matches(selectors, labels, ["module_id"]).select("module_id", F.col("selector").alias("source"), "target")
    services = rows.where("row = 'node' and kind = 'service-endpoint'").select("module_id", F.col("id").alias("target"))
    inbound = rows.where("row = 'route'").select("module_id", F.col("id").alias("source"), "target").join(services, ["module_id", "target"], "left_semi").select("module_id", "source", "target")
    edges = routes.unionByName(inbound).select("*", F.lit("routes_to").alias("relation"), F.lit("confirmed").alias("confidence"))
    nodes = rows.where("row = 'node' or error is not null").select("module_id", "id", "label", "kind", "confidence", "environment", F.col("v").alias("images"), "error")
    return nodes, edges


def dockerfile(sources: DataFrame) -> DataFrame:
    """(module_id, pos, image): the base image of every FROM, options skipped; column expressions only."""
    lines = sources.select("module_id", F.posexplode(F.split("source", "\r?\n")).alias("pos", "line"))
    image = F.regexp_extract("line", r"(?i)^\s*FROM\s+(?:--\S+\s+)*([^\s-]\S*|-[^\s-]\S*)", 1)
    return lines.select("module_id", "pos", image.alias("image")).where("image != ''")
