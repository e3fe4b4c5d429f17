"""Command line: call-graph, class-diagram, sequence-diagram, timing, use-cases, ci, deployment and comment."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, graph
from .plans import behaviour, diagrams, render
from .sources import comments, files, python_facts, sinks, yaml_facts


def _one(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("module_id"), F.col("value").alias("source"))


def _show(rows: DataFrame, column: str = "content") -> None:
    for r in rows.select(column).toLocalIterator():
        print(r[0])


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    src = _one(spark, args.path) if args.command != "deployment" else None
    if args.command in ("call-graph", "class-diagram", "sequence-diagram"):
        entities = python_facts.facts(src, "entities")
        if args.command == "sequence-diagram":
            _show(diagrams.sequence_diagrams(entities, args.max_depth, args.show_returns))
            return 0
        if args.command == "class-diagram":
            out = diagrams.class_diagrams(entities, args.fan_in_threshold)
        else:
            edges = diagrams.raw_call_edges(entities)
            if args.root:
                reached = graph.reachable(edges, spark.createDataFrame([(args.root,)], "node string"), args.max_depth)
                edges = graph.reachable_edges(edges, reached, args.max_depth)
            out = diagrams.bundle(edges, None, "call_graph", args.fan_in_threshold)
        if args.output_dir:
            print(sinks.write_files(sinks.placed(out, args.command.replace("-", "_") + "s"), args.output_dir), "files")
        else:
            _show(out.orderBy("shared", "diagram"))
        return 0
    if args.command == "timing":
        events = python_facts.facts(src, "timing").where("owner is not null")
        charts = events.groupBy("owner").agg(F.max("is_async").alias("is_async")).withColumn("diagram", F.col("owner"))
        _show(behaviour.timing_chart(charts, events.withColumn("diagram", F.col("owner"))).orderBy("diagram"))
        return 0
    if args.command == "use-cases":
        _show(python_facts.facts(src, "inputs").orderBy("line").select(F.concat_ws(" ", "scope", "component", "event", "handler").alias("content")))
        return 0
    if args.command == "comment":
        found = comments.candidates(src, args.language)
        _show(comments.insert(src, found), "source")
        return 0
    if args.command == "ci":
        steps = yaml_facts.ci_steps(src).where("error is null").withColumnRenamed("module_id", "workflow")
        steps = steps.withColumn("text", evaluate.step_text("name", "command", "action")).withColumn("is_test", evaluate.is_test(F.col("text"))).withColumn("is_build", evaluate.is_build(F.col("text")))
        jobs = yaml_facts.ci_jobs(src).where("error is null")
        needs = jobs.select(F.col("module_id").alias("workflow"), "job", F.explode("needs").alias("need"))
        workflows = jobs.select(F.col("module_id").alias("workflow"))
        missing = evaluate.missing_test(steps, workflows=workflows).select(F.lit("error missing-test").alias("content"))
        build = evaluate.build_without_test(steps, needs).select(F.concat(F.lit("warning build-without-test-dependency "), "job").alias("content"))
        twice = evaluate.duplicate_commands(steps).select(F.concat(F.lit("warning duplicate-command "), "command").alias("content"))
        found = missing.unionByName(build).unionByName(twice).collect()
        print("\n".join(r[0] for r in found))
        return int(args.check and any(r[0].startswith("error") for r in found))
    rows = files.deployment_files(files.listing(spark, args.path))
    texts = files.read_sources(spark, args.path)
    src = texts.join(rows.select(F.col("file").alias("module_id"), "kind"), "module_id")
    nodes, edges = yaml_facts.kubernetes(src.where("kind = 'kubernetes'"))
    compose = yaml_facts.compose(src.where("kind = 'compose'"))
    links = edges.select(F.col("source").alias("caller"), F.col("target").alias("callee")).unionByName(compose.where("row = 'edge'").select(F.col("id").alias("caller"), F.col("target").alias("callee")))
    points = nodes.where("id is not null").select(F.col("id").alias("node")).unionByName(compose.where("row = 'node'").select(F.col("id").alias("node")))
    _show(render.call_graph(links, points))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("call-graph", "class-diagram", "sequence-diagram", "timing", "use-cases", "ci", "deployment", "comment"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--output-dir")
        p.add_argument("--fan-in-threshold", type=int, default=3)
        p.add_argument("--root")
        p.add_argument("--max-depth", type=int, default=8 if name == "sequence-diagram" else None)
        p.add_argument("--show-returns", action="store_true")
        p.add_argument("--language", default="python")
        p.add_argument("--check", action="store_true")
    return top


def main() -> int:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    try:
        return run(spark, args)
    finally:
        spark.stop()


if __name__ == "__main__":
    raise SystemExit(main())
