from pyspark.sql import functions as F

from stratum.operators import blocks, evaluate, materialize
from stratum.plans.views import register, table
from stratum.sources import catalog, corpus

SF = "/root/testdata/sf0.001"


def test_a_layout_holds_every_row_and_prunes(spark, tmp_path):
    orders, path = table(spark, SF, "orders"), f"file://{tmp_path}/orders"
    materialize.write_layout(orders, path, "o_orderdate", ["o_orderkey"])
    assert materialize.read_partition(spark, path).count() == orders.count()
    part = materialize.read_partition(spark, path, [2, 3], ["o_orderkey"])
    assert part.columns == ["o_orderkey"] and part.count() == orders.count() // 5
    got, whole = evaluate.scan_metrics(part), evaluate.scan_metrics(materialize.read_partition(spark, path))
    assert got["numOutputRows"] == part.count() and got["filesSize"] < whole["filesSize"] / 3
    assert materialize.release(spark, path)


def test_substitution_keeps_results_and_guards(spark, tmp_path):
    register(spark, SF)
    sql = "SELECT c_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000 GROUP BY c_name"
    want = sorted(map(tuple, spark.sql(sql).collect()))
    orders = table(spark, SF, "orders")
    hits = spark.sql("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
    touched = [r.block_id for r in blocks.touched_blocks(orders, hits, ["o_totalprice", "o_orderkey"], ["o_orderkey"]).collect()]
    assert len(touched) < 6
    small = materialize.partition_rows(orders, ["o_totalprice", "o_orderkey"], touched).drop("block_id")
    assert set(evaluate.substitute(spark, sql, {"orders": small})) == {"orders"}
    assert sorted(map(tuple, spark.sql(sql).collect())) == want
    register(spark, SF)
    anti = "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"
    assert evaluate.substitute(spark, anti, {"orders": small}) == {}
    register(spark, SF)


def test_workloads_and_timing(spark):
    register(spark, SF)
    drawn = evaluate.sample_workload(spark, ["a", "b", "c"], 300, seed=2)
    counts = {r.query_id: r["count"] for r in drawn.groupBy("query_id").count().collect()}
    assert set(counts) == {"a", "b", "c"} and min(counts.values()) > 60
    assert drawn.orderBy("position").collect() == evaluate.sample_workload(spark, ["a", "b", "c"], 300, seed=2).orderBy("position").collect()
    assert evaluate.run_ms(spark, ["SELECT count(*) FROM nation"], repeat=2) > 0
    assert {"parsing", "analysis"} <= set(evaluate.phase_ms(spark, "SELECT count(*) FROM nation"))


def test_catalog_and_corpus(spark, tmp_path):
    got = catalog.catalog(spark, SF, ("nation", "orders"))
    assert got["nation"].rows == 25 and got["orders"].columns[0] == "o_orderkey" and got["orders"].size_mb > 0
    (tmp_path / "q").mkdir()
    (tmp_path / "q/one.sql").write_text("SELECT 1\n  FROM nation\n;\n")
    (tmp_path / "q/two.sql").write_text("SELECT 2")
    rows = {r.query_id: r.sql for r in corpus.sql_corpus(spark, f"file://{tmp_path}/q").collect()}
    assert rows == {"one": "SELECT 1 FROM nation", "two": "SELECT 2"} and corpus.query_names(spark, f"file://{tmp_path}/q") == ["one", "two"]
    df = spark.createDataFrame([(1, None), (2, "b|c")], "a int, b string")
    corpus.save_delimited(df, f"file://{tmp_path}/d")
    assert sorted(map(tuple, corpus.load_delimited(spark, f"file://{tmp_path}/d", df.schema).collect()), key=str) == [(1, None), (2, "b|c")]
    corpus.save_csv(df, f"file://{tmp_path}/c")
    assert corpus.load_csv(spark, f"file://{tmp_path}/c", df.schema).count() == 2


def test_hash_partitions_and_buckets(spark, tmp_path):
    orders = table(spark, SF, "orders")
    materialize.write_hashed(orders, f"file://{tmp_path}/h", ["o_custkey"])
    back = spark.read.parquet(f"file://{tmp_path}/h")
    assert back.count() == orders.count() and back.groupBy("o_custkey").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    materialize.write_bucketed(orders, "bucketed_orders", ["o_custkey"])
    plan = spark.table("bucketed_orders").groupBy("o_custkey").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE bucketed_orders")
    assert materialize.partition_name("orders", "q1") == "orders_q1_p"
