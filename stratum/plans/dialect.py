"""The SQL constructs that a workload may hold, one registered query each.

Every query is declarative: Catalyst prunes columns, pushes filters into the Parquet scans, decorrelates subqueries
and picks the joins. Where Spark and DuckDB spell a thing differently, a pair (Spark, DuckDB) is given.
"""

from __future__ import annotations

#: name -> one SQL text for both engines, or (Spark SQL, DuckDB SQL).
DIALECT: dict[str, str | tuple[str, str]] = {
    # projection
    "proj_star": "SELECT * FROM nation WHERE n_regionkey <> 1",
    "proj_qualified_columns": "SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 9000",
    "proj_expr_alias": "SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 4) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_quantity, 4) AS unit_gross FROM lineitem WHERE l_quantity > 45",
    "proj_alias_chain": "SELECT s.o_orderkey, round(s.gross - s.net, 4) AS spread FROM (SELECT t.o_orderkey, t.net * 1.1 AS gross, t.net FROM (SELECT o_orderkey, o_totalprice * 0.9 AS net FROM orders) t) s WHERE s.net > 300000",
    "proj_functions": "SELECT p_partkey, upper(substring(p_name, 1, 5)) AS head, abs(p_size - 25) AS off, round(p_retailprice, 1) AS price, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS brand, CAST(length(p_type) AS BIGINT) AS n FROM part",
    "proj_ambiguous_columns": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    "agg_functions": "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS lowest, max(o_totalprice) AS highest, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(stddev_samp(o_totalprice), 2) AS spread FROM orders GROUP BY o_orderpriority",
    "agg_nested_arguments": "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(sum(coalesce(abs(l_tax - l_discount), 0)), 4) AS gap FROM lineitem GROUP BY l_returnflag",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 AND o_orderstatus = 'O' THEN 'open' ELSE o_orderpriority END AS class FROM orders",
    "case_without_else": "SELECT l_returnflag, sum(CASE WHEN l_quantity > 25 THEN 1 END) AS big, count(CASE WHEN l_discount > 0.05 THEN l_orderkey END) AS cheap FROM lineitem GROUP BY l_returnflag",
    "case_simple": "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN n_name ELSE 'other' END AS label FROM nation",
    "case_scalar_subquery": "SELECT c_custkey, CASE WHEN c_acctbal > (SELECT avg(c_acctbal) FROM customer) THEN 'above' ELSE 'below' END AS side FROM customer",
    "cast_ops": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_custkey AS VARCHAR(20)) AS cust, CAST(o_orderdate AS DATE) AS day, CAST('12' AS INTEGER) + 1 AS thirteen FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_orderkey % 7 = 0",
    "extract_parts": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d FROM orders",
    "date_interval": (
        "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate + INTERVAL 90 DAY AS due FROM lineitem WHERE l_shipdate < TIMESTAMP_NTZ '1995-06-01 00:00:00' + INTERVAL 1 MONTH",
        "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate + INTERVAL '90' DAY AS due FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01 00:00:00' + INTERVAL '1' MONTH",
    ),
    # windows
    "win_rank_partition_order": "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders",
    "win_rank_order_only": "SELECT n_nationkey, CAST(rank() OVER (ORDER BY n_regionkey) AS BIGINT) AS place FROM nation",
    "win_rank_ties": "SELECT s_suppkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000)) AS BIGINT) AS place, CAST(dense_rank() OVER (PARTITION BY s_nationkey ORDER BY round(s_acctbal / 1000)) AS BIGINT) AS step FROM supplier",
    "win_agg_partition": "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "win_agg_empty_spec": "SELECT n_nationkey, count(*) OVER () AS n, max(n_regionkey) OVER () AS top FROM nation",
    "win_agg_order_default_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running FROM orders",
    "win_agg_running_rows": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "win_lag_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders",
    # predicates
    "pred_between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice NOT BETWEEN 950 AND 980",
    "pred_between_case": "SELECT p_partkey FROM part WHERE CASE WHEN p_size > 25 THEN p_size - 25 ELSE p_size END BETWEEN 5 AND 9",
    "pred_between_subqueries": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN (SELECT avg(o_totalprice) FROM orders) AND (SELECT 0.9 * max(o_totalprice) FROM orders)",
    "pred_comparisons": "SELECT s_suppkey FROM supplier WHERE s_acctbal >= 100 AND s_acctbal <= 5000 AND s_nationkey <> 3 AND s_suppkey > 2 AND s_nationkey < 24",
    "pred_in_list": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (1, 2, 3)",
    "pred_in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "pred_not_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)",
    "pred_not_in_with_null": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN NULL ELSE r_regionkey END FROM region)",
    "pred_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "pred_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "pred_like": "SELECT p_partkey FROM part WHERE p_type LIKE '%PROMO' OR p_name LIKE '%1_' OR p_brand NOT LIKE 'Brand%'",
    "pred_is_null": "SELECT c.c_custkey, (o.o_orderkey IS NULL) AS missing FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL OR o.o_orderstatus IS NOT NULL",
    "pred_or_and": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_quantity < 3 AND l_discount > 0.05) OR (l_quantity > 48 AND (l_tax < 0.02 OR l_returnflag = 'R'))",
    "pred_not": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' OR o_totalprice < 200000)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders WHERE o_orderstatus = 'F')",
    "scalar_subquery_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.4 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "scalar_subquery_grouped": "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT max(m) FROM (SELECT avg(c_acctbal) AS m FROM customer GROUP BY c_mktsegment) g)",
    # joins
    "join_on_inner": "SELECT c_custkey, o_orderkey FROM customer INNER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000",
    "join_on_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000",
    "join_on_right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_on_full": "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON s_nationkey = c_nationkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < 2",
    "join_comma": "SELECT n_name, r_name, s_suppkey FROM nation, region, supplier WHERE n_regionkey = r_regionkey AND s_nationkey = n_nationkey AND r_name <> 'ASIA'",
    "join_using": "SELECT k, a, b FROM (SELECT o_custkey AS k, count(*) AS a FROM orders GROUP BY o_custkey) x JOIN (SELECT c_custkey AS k, c_mktsegment AS b FROM customer) y USING (k)",
    "join_natural": "SELECT n_regionkey, cnt, tag FROM (SELECT n_regionkey, count(*) AS cnt FROM nation GROUP BY n_regionkey) x NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name AS tag FROM region) y",
    "join_semi_multi_key": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderdate < l_shipdate AND o_orderpriority = '1-URGENT')",
    "self_join_two_instances": "SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE a.s_acctbal > 0 AND b.s_acctbal < 0",
    # CTEs, derived tables, grouping, ordering
    "cte_chain": "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM big GROUP BY o_custkey) SELECT c_name, n, total FROM per JOIN customer ON o_custkey = c_custkey WHERE n > 3",
    "cte_reused": "WITH v AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, revenue FROM supplier JOIN v ON s_suppkey = l_suppkey WHERE revenue = (SELECT max(revenue) FROM v)",
    "derived_table": "SELECT n_name, d.n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) d, nation WHERE d.c_nationkey = n_nationkey",
    "derived_table_in_join": "SELECT p_partkey, d.q FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey) d ON p_partkey = d.l_partkey WHERE p_size = 15",
    "group_having_order": "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) > 0.9 * (SELECT avg(t) FROM (SELECT sum(l_quantity) AS t FROM lineitem GROUP BY l_suppkey) x) ORDER BY q DESC, l_suppkey",
    "group_by_expression": "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate), o_orderstatus",
    "order_by_case": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 300000 ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END DESC, o_orderkey ASC",
    "order_limit_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "rollup": "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "cube": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer WHERE c_nationkey < 4 GROUP BY CUBE (c_mktsegment, c_nationkey)",
    # set operations
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation",
    "intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000",
    # whole analytic queries in the style of the public decision-support benchmarks
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= CAST('1998-09-02 00:00:00' AS TIMESTAMP) GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < CAST('1995-03-15 00:00:00' AS TIMESTAMP) AND l_shipdate > CAST('1995-03-15 00:00:00' AS TIMESTAMP) GROUP BY l_orderkey, o_orderdate",
    "tpch_q4": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q7": "SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey <> n2.n_regionkey) AS shipping GROUP BY supp_nation, cust_nation, l_year",
    "tpch_q10": "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name",
    "tpch_q14": "SELECT round(100.0 * sum(CASE WHEN p_type LIKE '%PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share FROM lineitem, part WHERE l_partkey = p_partkey",
    "tpch_q18": "SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS q FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice",
    "tpch_q22": "SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY c_mktsegment",
}


def spark_text(name: str) -> str:
    text = DIALECT[name]
    text = text if isinstance(text, str) else text[0]
    # the tables' timestamps have no zone
    return text.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")


def duck_text(name: str) -> str:
    text = DIALECT[name]
    return text if isinstance(text, str) else text[1]
