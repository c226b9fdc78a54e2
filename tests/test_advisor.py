import pytest

from stratum.advisor import Advisor
from stratum.cli import parser, run
from stratum.plans import provenance
from stratum.plans.views import register
from stratum.plans.workload import KEYS, WORKLOAD, spark_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", WORKLOAD)
def test_hits_come_from_the_plan(spark, name):
    register(spark, SF)
    query = WORKLOAD[name]
    got = provenance.hits(spark, query.sql, KEYS)
    assert set(got) == set(query.hits)
    for t, sql in query.hits.items():
        assert {tuple(r) for r in got[t].collect()} == {tuple(r) for r in spark.sql(spark_sql(sql)).collect()}


def test_star_and_self_joins(spark):
    register(spark, SF)
    sql = "SELECT a.n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE b.n_nationkey = 20 ORDER BY 1 LIMIT 3"
    assert len(provenance.star(spark, sql).columns) == 6
    got = {r.n_nationkey for r in provenance.hits(spark, sql, {"nation": ["n_nationkey"]})["nation"].collect()}
    want = spark.sql("SELECT a.n_nationkey AS x FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE b.n_nationkey = 20")
    assert got == {r.x for r in want.collect()} | {20}
    having = "SELECT o_custkey, sum(o_totalprice) AS s FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey HAVING sum(o_totalprice) > 200000"
    assert provenance.hits(spark, having, KEYS)["orders"].count() == spark.table("orders").where("o_totalprice > 100000").count()


def test_advice_keeps_results_and_reads_less(spark, tmp_path):
    queries = {n: q.sql for n, q in WORKLOAD.items()}
    advisor = Advisor(spark, SF, queries, {t: KEYS[t] for t in ("orders", "customer")})
    layouts = advisor.recommend()
    assert set(layouts) == {"orders", "customer"}
    assert all(advisor.costs()[t].size < advisor.tables[t].size_mb for t in layouts)
    advisor.materialize(layouts, f"file://{tmp_path}/layout")
    for q in queries:
        before, after = (sorted(str([round(v, 4) if isinstance(v, float) else v for v in r]) for r in advisor.run(q, original).collect()) for original in (True, False))
        assert before == after
    got = {r.query_id: (r.before_bytes, r.after_bytes) for r in advisor.compare().collect()}
    assert set(got) == set(queries) and got["small_promo"][0] == got["small_promo"][1]
    grown = [tuple(r) for r in advisor.experiment((20, 50)).collect()]
    assert [g[0] for g in grown] == [20, 50] and grown[1][1] > grown[0][1]


def test_command_line(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q/a.sql").write_text("SELECT c_name FROM customer WHERE c_acctbal > 9000;")
    run(spark, parser().parse_args(["advise", SF, f"file://{tmp_path}/q", f"file://{tmp_path}/out", "--key", "customer=c_custkey"]))
    assert spark.read.parquet(f"file://{tmp_path}/out/customer").count() == 150
    run(spark, parser().parse_args(["generate", f"file://{tmp_path}/rates", "--templates", "3", "--steps", "60"]))
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/rates").count() == 60
    spark.range(400).selectExpr("1L AS template_id", "id AS t", "sin(id / 7) AS rate").write.parquet(f"file://{tmp_path}/r")
    run(spark, parser().parse_args(["forecast", f"file://{tmp_path}/r", f"file://{tmp_path}/f", "--horizon", "5"]))
    assert (tmp_path / "f").exists()
