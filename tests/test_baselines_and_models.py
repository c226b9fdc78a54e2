import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import baselines, perfmodel
from stratum.streaming import rates


def test_affinity_by_hand(spark):
    make = spark.createDataFrame
    freq = make([("q1", 0.6), ("q2", 0.4)], "query_id string, freq double")
    used = baselines.usage(make([("q1", 0), ("q2", 1)], "query_id string, c int"), make([("q1", 0), ("q1", 1)], "query_id string, c int"), freq, make([(0,), (1,), (2,)], "c int"))
    got = {(r.i, r.j): r.aff for r in baselines.affinity(used).collect()}
    assert got[0, 0] == pytest.approx(0.6) and got[0, 1] == pytest.approx(0.6 * (1 + 0.6) / 2 / 1 + 0.4 * 0.4 / 2 / 0.4) and got[0, 2] == pytest.approx(0.6 / 2) and got[2, 2] == 0


def test_frequent_attributes_and_sets(spark):
    used = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q2", "b")], "query_id string, column_name string")
    freq = spark.createDataFrame([("q1", 0.6), ("q2", 0.4)], "query_id string, freq double")
    assert {r.column_name: round(r.support, 6) for r in baselines.frequent_attributes(used, freq).collect()} == {"a": 0.6, "b": 1.0}
    assert baselines.hash_attributes(used, freq) == ["b"]


def test_average_linkage():
    matrix = np.array([[9, 8, 0, 0], [8, 9, 0, 1], [0, 0, 9, 7], [0, 1, 7, 9]], float)
    assert baselines.affinity_groups(matrix, 2) == [0, 0, 1, 1] and baselines.affinity_groups(matrix, 4) == [0, 1, 2, 3]


def test_run_time_model_learns(spark):
    rows = spark.range(300).select((F.col("id") % 97).alias("workload_size"), F.rand(3).alias("parse_ms"), ((F.col("id") % 97) * 3 + 5).cast("double").alias("runtime"))
    fit = perfmodel.fit(rows, trees=15, depth=4, folds=2)
    assert fit.r2 > 0.9 and fit.rmse < 30 and fit.cv_rmse > 0 and len(fit.curve) == 15 and fit.curve[-1][1] < fit.curve[0][1]


def test_streamed_rates_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"file://{tmp_path}/in")
    stream = rates.rates(rates.read_events(spark, f"file://{tmp_path}/in", events.schema), late="1 hour")
    got = {}

    def update(batch, _):
        for r in batch.collect():
            got[r.start, r.event_type] = r.n

    rates.keep_up(stream, update, f"file://{tmp_path}/checkpoint").awaitTermination()
    want = {(r.start, r.event_type): r.n for r in rates.rates(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    # the last hour is still open
    assert len(got) > 0.9 * len(want) and all(want[k] == n for k, n in got.items())
