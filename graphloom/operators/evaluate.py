"""Rules over CI steps and design metrics: findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the rules.
TEST_WORDS = ("test", "pytest", "unittest")
BUILD_WORDS = ("build", "package", "compile")


def step_text(name: Column | str, command: Column | str, action: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) if isinstance(c, str) else c for c in (name, command, action))))


def is_test(text: Column) -> Column:
    return text.rlike("|".join(TEST_WORDS))


def is_build(text: Column) -> Column:
    return text.rlike("|".join(BUILD_WORDS))


def missing_test(steps: DataFrame, workflow: str = "workflow", workflows: DataFrame | None = None) -> DataFrame:
    """steps (workflow, job, is_test, is_build, pos): workflows without any test step.

    `workflows` (workflow, ...) adds those that may have no step at all.
    """
    marks = steps.select(workflow, F.coalesce(F.col("is_test"), F.lit(False)).cast("int").alias("t"))
    if workflows is not None:
        marks = marks.unionByName(workflows.select(workflow, F.lit(0).alias("t")))
    return marks.groupBy(workflow).agg(F.max("t").alias("t")).where("t = 0").select(workflow)


def build_without_test(steps: DataFrame, needs: DataFrame, workflow: str = "workflow") -> DataFrame:
    """(workflow, job): jobs that build, test nothing before their first build step and need no test job.

    Per job one aggregate: the first build position against the first test position.
    Workflows without a test job are left to `missing_test`.
    """
    jobs = steps.groupBy(workflow, "job").agg(F.min(F.when(F.col("is_build"), F.col("pos"))).alias("b"), F.min(F.when(F.col("is_test"), F.col("pos"))).alias("t"))
    tests = jobs.where("t is not null").select(workflow, F.col("job").alias("need"))
    behind = needs.select(workflow, "job", "need").join(tests, [workflow, "need"], "left_semi").select(workflow, "job").distinct()
    open_jobs = jobs.where("b is not null and (t is null or t > b)").join(behind, [workflow, "job"], "left_anti")
    return open_jobs.join(tests.select(workflow).distinct(), workflow, "left_semi").select(workflow, "job")


def duplicate_commands(steps: DataFrame, workflow: str = "workflow") -> DataFrame:
    """(workflow, command, n, jobs): commands of two steps or more, their jobs sorted and as often as they use it."""
    trimmed = steps.where("command != ''").select(workflow, "job", F.regexp_replace("command", r"^\s+|\s+$", "").alias("command"))
    return trimmed.groupBy(workflow, "command").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("job")), ", ").alias("jobs")).where("n > 1")


def merge_confident(rows: DataFrame, keys: list[str], rank: Column, order: list[str | Column]) -> DataFrame:
    """Of rows with equal keys the one with the highest rank, the first in `order` on a tie; an aggregate, no window."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((-rank).alias("r"), *order)).alias("__row"))
    return picked.select(*keys, *(F.col(f"__row.`{c}`").alias(c) for c in rest))


CONFIDENCE = {"confirmed": 2, "inferred": 1, "unknown": 0}


def confidence_rank(c: Column) -> Column:
    rank = F.lit(-1)
    for name, value in CONFIDENCE.items():
        rank = F.when(c == name, F.lit(value)).otherwise(rank)
    return rank


def hub_findings(fan_in: DataFrame, fan_out: DataFrame, scope: str, high_in: int = 3, high_out: int = 5) -> DataFrame:
    """(code, severity, subject, value)."""
    if min(high_in, high_out) < 1:
        raise ValueError("thresholds must be at least 1")
    a = fan_in.where(F.col("fan_in") >= high_in).select(F.lit(f"high-fan-in-{scope}").alias("code"), F.lit("info").alias("severity"), F.col("node").alias("subject"), F.col("fan_in").cast("double").alias("value"))
    b = fan_out.where(F.col("fan_out") >= high_out).select(F.lit(f"high-fan-out-{scope}").alias("code"), F.lit("warning").alias("severity"), F.col("node").alias("subject"), F.col("fan_out").cast("double").alias("value"))
    return a.unionByName(b)


def partition_findings(series: DataFrame, hubs: DataFrame, stats: DataFrame, large: int = 8, ratio: float = 0.25) -> DataFrame:
    """large-series, shared-dependency-hubs and cross-series-coupling of one graph."""
    if large < 1 or not 0 <= ratio <= 1:
        raise ValueError("a threshold is out of range")
    a = series.groupBy("series_root").agg(F.count("*").alias("n")).where(F.col("n") >= large).select(F.lit("large-series").alias("code"), F.lit("warning").alias("severity"), F.col("series_root").alias("subject"), F.col("n").cast("double").alias("value"))
    b = hubs.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("shared-dependency-hubs").alias("code"), F.lit("info").alias("severity"), F.lit("graph").alias("subject"), F.col("n").cast("double").alias("value"))
    c = stats.where((F.col("metric") == "cross_series_ratio") & (F.col("value") >= ratio) & (F.col("value") > 0)).select(F.lit("cross-series-coupling").alias("code"), F.lit("warning").alias("severity"), F.lit("graph").alias("subject"), "value")
    return a.unionByName(b).unionByName(c)


def scc_findings(components: DataFrame, edges: DataFrame) -> DataFrame:
    """A finding for each strong component with a cycle: its smallest member and its size."""
    loops = edges.where("caller = callee").select(F.col("caller").alias("node")).distinct().withColumn("loop", F.lit(1))
    sizes = components.join(loops, "node", "left").groupBy("component").agg(F.count("*").alias("n"), F.max("loop").alias("loop")).where("n > 1 or loop = 1")
    return sizes.select(F.lit("strongly-connected-component").alias("code"), F.lit("warning").alias("severity"), F.col("component").alias("subject"), F.col("n").cast("double").alias("value"))


def previous_content(lines: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """lines with `previous`: the last line before that isn't blank, trimmed."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("previous", F.last(F.when(F.trim(text) != "", F.trim(text)), ignorenulls=True).over(w))
