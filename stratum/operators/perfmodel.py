"""A learned run-time model over workload features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("workload_size", "distinct_queries", "parse_ms", "n_select", "n_from", "n_where", "block_size", "block_num", "partition_num")
LABEL = "runtime"


def workload_features(workloads: DataFrame, queries: DataFrame, layout: DataFrame) -> DataFrame:
    """One row of features per workload.

    workloads: (workload_id, position, query_id); queries: (query_id, parse_ms, n_select, n_from, n_where); layout: one
    row (block_size, block_num, partition_num). Sums count a query as often as it occurs.
    """
    joined = workloads.join(queries, "query_id")
    per = joined.groupBy("workload_id").agg(
        F.count("*").alias("workload_size"),
        F.countDistinct("query_id").alias("distinct_queries"),
        *[F.sum(c).alias(c) for c in ("parse_ms", "n_select", "n_from", "n_where")],
    )
    return per.join(F.broadcast(layout), how="cross")  # one row


@dataclass(frozen=True)
class Fit:
    model: object
    rmse: float
    r2: float
    cv_rmse: float | None
    predictions: DataFrame
    curve: list[tuple[int, float]]


def fit(samples: DataFrame, trees: int = 300, rate: float = 0.08, subsample: float = 0.75, depth: int = 7, share: float = 0.9, seed: int = 420, folds: int = 10) -> Fit:
    """Boosted trees on a 90/10 split: rmse and r2 of the held-out part, mean rmse over the folds (none for folds < 2),
    predictions (i, y, yhat) and the loss after each tree."""
    train, test = samples.randomSplit([share, 1 - share], seed)
    assemble = VectorAssembler(inputCols=[c for c in FEATURES if c in samples.columns], outputCol="features")
    trees_ = GBTRegressor(labelCol=LABEL, maxIter=trees, stepSize=rate, subsamplingRate=subsample, maxDepth=depth, seed=seed)
    pipeline = Pipeline(stages=[assemble, trees_])
    model = pipeline.fit(train)
    predicted = model.transform(test)
    by = lambda metric: RegressionEvaluator(labelCol=LABEL, metricName=metric)
    cv = None
    if folds >= 2:
        validator = CrossValidator(estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=by("rmse"), numFolds=folds, seed=seed)
        cv = float(validator.fit(samples).avgMetrics[0])
    curve = [(i, float(x)) for i, x in enumerate(model.stages[-1].evaluateEachIteration(assemble.transform(test), "squared"))]
    rows = predicted.select(F.monotonically_increasing_id().alias("i"), F.col(LABEL).alias("y"), F.col("prediction").alias("yhat"))
    return Fit(model, float(by("rmse").evaluate(predicted)), float(by("r2").evaluate(predicted)), cv, rows, curve)
