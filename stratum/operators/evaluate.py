"""Evaluation: workloads, view substitution, scanned bytes and run times."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.plans.lineage import prunable

SIZES = (20, 50, 100, 200, 500, 1000)


def sample_workload(spark: SparkSession, names: Sequence[str], size: int, seed: int = 0) -> DataFrame:
    """(position, query_id): queries drawn uniformly with replacement, the same for the same seed."""
    listed = spark.createDataFrame(list(enumerate(sorted(names))), "pick long, query_id string")
    # MD5, so that any engine can draw the same
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = spark.range(size).select(F.col("id").alias("position"), F.pmod(digest, F.lit(len(names))).alias("pick"))
    return drawn.join(F.broadcast(listed), "pick").select("position", "query_id")


def workload_scan_size(workload: DataFrame, used: DataFrame, sizes: DataFrame) -> DataFrame:
    """Total MB that a workload reads: used has (query_id, relation), sizes (relation, size_mb); repeats count."""
    per_query = used.join(sizes, "relation").groupBy("query_id").agg(F.sum("size_mb").alias("size_mb"))
    return workload.join(per_query, "query_id").agg(F.sum("size_mb").alias("scan_mb"))


def substitute(spark: SparkSession, sql: str, relations: Mapping[str, DataFrame], guarded: bool = True) -> dict[str, DataFrame]:
    """Registers smaller relations in place of tables and gives those that were replaced; the SQL stays as it is.

    A table is replaced only if the query reads it on monotone paths alone; else rows that never reach the result
    would still matter.
    """
    fine = prunable(spark, sql) if guarded else set(relations)
    used = {t: df for t, df in relations.items() if t in fine}
    for t, df in used.items():
        df.createOrReplaceTempView(t)
    return used


def _scans(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _scans(plan.executedPlan())
        return
    if kind.endswith("QueryStageExec"):
        yield from _scans(plan.plan())
        return
    if kind == "FileSourceScanExec":
        yield plan
    for source in (plan.children(), plan.subqueries()):
        for i in range(source.size()):
            yield from _scans(source.apply(i))


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """Runs a frame's plan and sums its file scans: filesSize (bytes), numFiles, numOutputRows."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    total = {"filesSize": 0, "numFiles": 0, "numOutputRows": 0}
    for scan in _scans(execution.executedPlan()):
        metrics = scan.metrics()
        for name in total:
            if metrics.contains(name):
                total[name] += int(metrics.apply(name).value())
    return total


def phase_ms(spark: SparkSession, sql: str) -> dict[str, float]:
    """Milliseconds of parsing, analysis, optimisation and planning of one query."""
    execution = spark.sql(sql)._jdf.queryExecution()
    execution.executedPlan()
    phases, out = execution.tracker().phases(), {}
    it = phases.iterator()
    while it.hasNext():
        pair = it.next()
        out[pair._1()] = float(pair._2().endTimeMs() - pair._2().startTimeMs())
    return out


def run_ms(spark: SparkSession, queries: Sequence[str], repeat: int = 3) -> float:
    """Mean over the repetitions of the workload's summed run time; results are computed in full and thrown away."""
    totals = []
    for _ in range(repeat):
        total = 0.0
        for sql in queries:
            spark.catalog.clearCache()
            began = time.perf_counter()
            spark.sql(sql).write.format("noop").mode("overwrite").save()
            total += (time.perf_counter() - began) * 1000
        totals.append(total)
    return sum(totals) / len(totals)
