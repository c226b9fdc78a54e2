"""A workload over the driver tables: each query with the keys of the base rows that it touches."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Query:
    """sql is what users run; hits gives, per table, a query for the keys of the rows that reach its joined rows."""

    sql: str
    hits: dict[str, str]


#: Sort-key candidates and row keys of the tables that are laid out.
KEYS: dict[str, tuple[str, ...]] = {
    "orders": ("o_orderkey",),
    "customer": ("c_custkey",),
    "part": ("p_partkey",),
    "supplier": ("s_suppkey",),
}

WORKLOAD: dict[str, Query] = {
    "urgent_spring": Query(
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1995-03-01 00:00:00' AND o_orderdate < TIMESTAMP_NTZ '1995-06-01 00:00:00' AND o_orderpriority = '1-URGENT'",
        {"orders": "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1995-06-01 00:00:00' AND o_orderpriority = '1-URGENT'"},
    ),
    "big_spenders": Query(
        "SELECT c_name, sum(o_totalprice) AS total FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 290000 GROUP BY c_name",
        {
            "orders": "SELECT o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 290000",
            "customer": "SELECT c_custkey FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 290000",
        },
    ),
    "segment_nation": Query(
        "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey BETWEEN 3 AND 6 GROUP BY c_nationkey",
        {"customer": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey BETWEEN 3 AND 6"},
    ),
    "small_promo": Query(
        "SELECT p_partkey, p_retailprice FROM part WHERE p_size < 6 AND p_type LIKE '%PROMO%' ORDER BY p_retailprice",
        {"part": "SELECT p_partkey FROM part WHERE p_size < 6 AND p_type LIKE '%PROMO%'"},
    ),
    "poor_suppliers": Query(
        "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 500",
        {"supplier": "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 500"},
    ),
    "idle_customers": Query(
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
        {"customer": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)"},
    ),
}


def spark_sql(text: str) -> str:
    """The tables' timestamps have no zone, so literals compared with them have none either."""
    return text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
