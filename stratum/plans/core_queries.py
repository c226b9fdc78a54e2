"""Registered queries of the layout advisor's own operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import arrival
from stratum.operators import agent, baselines, blocks, cluster, costmodel, encode, evaluate, forecast, materialize, perfmodel, search
from stratum.plans.lineage import lineage_frame, prunable
from stratum.plans.store import fresh_path
from stratum.plans.views import TABLES, register, run_sql, table
from stratum.plans.workload import KEYS, WORKLOAD, spark_sql
from stratum.sources import catalog, corpus

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _values(rows: list[tuple], names: str) -> str:
    def lit(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS v({names}))"


def _block_sql(source: str, order: list[str], keep: str) -> str:
    keys = ", ".join(f"{c} NULLS LAST" for c in order)
    return f"SELECT {keep}, CAST((row_number() OVER (ORDER BY {keys}) * 10 + count(*) OVER () - 1) // count(*) OVER () AS INTEGER) AS block_id FROM {source}"


# columns of the tables that are laid out, in file order (fixed values)
COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
}
COLUMNS = {t: c.split() for t, c in COLUMNS.items()}
_ADVISED = tuple(COLUMNS)

# catalog -------------------------------------------------------------------------------------------------------------


@_query("catalog_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.counts(spark, sf)


@_query("catalog_columns", f"SELECT table_name, CAST(position AS INTEGER) AS position, column_name FROM {_values([(t, i, c) for t, cs in COLUMNS.items() for i, c in enumerate(cs)], 'table_name, position, column_name')}")
def _columns(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.columns(spark, sf, _ADVISED)


@_query("catalog_sizes")
def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.catalog_frame(spark, sf, _ADVISED)


# blocks and locations ------------------------------------------------------------------------------------------------

_HEAVY = "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 49"


@_query(
    "blocks_orders_by_date",
    f"SELECT block_id, count(*) AS hit_rows FROM ({_block_sql('orders', ['o_orderdate', 'o_orderkey'], 'o_orderkey')}) b WHERE o_orderkey IN ({_HEAVY}) GROUP BY block_id",
)
def _flagship(spark: SparkSession, sf: str) -> DataFrame:
    hits = run_sql(spark, sf, _HEAVY)
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return blocks.touched_blocks(orders, hits, ["o_orderdate", "o_orderkey"], ["o_orderkey"])


@_query("block_number_orders", _block_sql("orders", ["o_totalprice", "o_orderkey"], "o_orderkey"))
def _orders_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.with_block(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "block_id")


_LINE = COLUMNS["lineitem"]
_BY_SHIP = ["l_shipdate", *[c for c in _LINE if c != "l_shipdate"]]


@_query("block_number_lineitem", _block_sql("lineitem", _BY_SHIP, "l_orderkey, l_linenumber, l_partkey, l_extendedprice"))
def _lineitem_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.with_block(table(spark, sf, "lineitem"), _BY_SHIP).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "block_id")


@_query("row_position_events", "SELECT event_id, CAST(row_number() OVER (ORDER BY value NULLS LAST, event_id) AS BIGINT) AS rn FROM events")
def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return blocks.with_position(table(spark, sf, "events").select("event_id", "value"), ["value", "event_id"]).select("event_id", F.col("rn").cast("long"))


def _candidate_sql(name: str) -> str:
    key = KEYS[name][0]
    return " UNION ALL ".join(f"SELECT {key}, '{c}' AS order_column, block_id FROM ({_block_sql(name, list(dict.fromkeys([c, key])), key)}) x" for c in COLUMNS[name])


@_query("block_histogram_all_columns", f"SELECT order_column, block_id, count(*) AS n, min(c_custkey) AS least, max(c_custkey) AS most FROM ({_candidate_sql('customer')}) a GROUP BY order_column, block_id")
def _histogram(spark: SparkSession, sf: str) -> DataFrame:
    placed = blocks.all_blocks(table(spark, sf, "customer"), COLUMNS["customer"], ["c_custkey"])
    return placed.groupBy("order_column", "block_id").agg(F.count("*").alias("n"), F.min("c_custkey").alias("least"), F.max("c_custkey").alias("most"))


def _joined(df: DataFrame, column: str = "blocks") -> DataFrame:
    """Arrays as text, which both engines print alike."""
    return df.withColumn(column, F.concat_ws(",", F.transform(column, lambda b: b.cast("string"))))


_LIST = "string_agg(CAST(block_id AS VARCHAR), ',' ORDER BY block_id)"


@_query(
    "query_location_orders",
    f"SELECT order_column, {_LIST} AS blocks FROM (SELECT DISTINCT order_column, block_id FROM ({_candidate_sql('orders')}) a WHERE o_orderkey IN ({WORKLOAD['urgent_spring'].hits['orders']})) d GROUP BY order_column",
)
def _location_orders(spark: SparkSession, sf: str) -> DataFrame:
    hits = run_sql(spark, sf, spark_sql(WORKLOAD["urgent_spring"].hits["orders"]))
    return _joined(blocks.locations(table(spark, sf, "orders"), hits, COLUMNS["orders"], KEYS["orders"]))


def _locations_sql() -> str:
    parts = [
        f"SELECT DISTINCT '{q}' AS query_id, '{t}' AS table_name, order_column, block_id FROM ({_candidate_sql(t)}) a WHERE {KEYS[t][0]} IN ({sql})"
        for q, query in WORKLOAD.items()
        for t, sql in query.hits.items()
    ]
    return " UNION ALL ".join(parts)


def locations(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, table_name, order_column, blocks) of the whole workload: each query runs once per table."""
    tables = {t: (table(spark, sf, t), COLUMNS[t], KEYS[t]) for t in KEYS}
    hits = {q: {t: run_sql(spark, sf, spark_sql(sql)) for t, sql in query.hits.items()} for q, query in WORKLOAD.items()}
    return blocks.locations_many(tables, hits)


@_query("query_location_multi_table", f"SELECT query_id, table_name, order_column, {_LIST} AS blocks FROM ({_locations_sql()}) u GROUP BY query_id, table_name, order_column")
def _location_many(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(locations(spark, sf))


@_query(
    "location_by_tuple_equality",
    f"SELECT block_id, count(*) AS hit_rows FROM ({_block_sql('part', ['p_partkey'], 'p_brand, p_size, p_type')}) b WHERE EXISTS (SELECT 1 FROM (SELECT p_brand, p_size, p_type FROM part WHERE p_retailprice > 998) r WHERE r.p_brand = b.p_brand AND r.p_size = b.p_size AND r.p_type = b.p_type) GROUP BY block_id",
)
def _by_equality(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    result = part.where("p_retailprice > 998").select("p_brand", "p_size", "p_type")
    return blocks.locate_by_equality(part, result, ["p_partkey"])


@_query(
    "location_self_join_instances",
    f"SELECT block_id, count(*) AS hit_rows FROM ({_block_sql('supplier', ['s_acctbal', 's_suppkey'], 's_suppkey')}) b WHERE s_suppkey IN (SELECT a.s_suppkey FROM supplier a JOIN supplier c ON a.s_nationkey = c.s_nationkey AND a.s_acctbal > 8000 AND c.s_acctbal < 0 UNION SELECT c.s_suppkey FROM supplier a JOIN supplier c ON a.s_nationkey = c.s_nationkey AND a.s_acctbal > 8000 AND c.s_acctbal < 0) GROUP BY block_id",
)
def _self_join(spark: SparkSession, sf: str) -> DataFrame:
    pairs = run_sql(spark, sf, "SELECT a.s_suppkey AS x, c.s_suppkey AS y FROM supplier a JOIN supplier c ON a.s_nationkey = c.s_nationkey AND a.s_acctbal > 8000 AND c.s_acctbal < 0")
    hits = pairs.select(F.explode(F.array("x", "y")).alias("s_suppkey")).distinct()
    return blocks.touched_blocks(table(spark, sf, "supplier"), hits, ["s_acctbal", "s_suppkey"], ["s_suppkey"])


# partitions ----------------------------------------------------------------------------------------------------------

_ORDERS_BY_PRICE = _block_sql("orders", ["o_totalprice", "o_orderkey"], "*")


@_query("partition_rows", f"SELECT * FROM ({_ORDERS_BY_PRICE}) b WHERE block_id IN (2, 3, 7)")
def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return materialize.partition_rows(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], [2, 3, 7])


@_query("partition_columns", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders")
def _vertical(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "vertical")
    materialize.write_vertical(table(spark, sf, "orders"), path, ["o_orderkey", "o_orderdate", "o_orderstatus"])
    return spark.read.parquet(path)


@_query("partition_hybrid", f"SELECT o_orderkey, o_totalprice FROM ({_ORDERS_BY_PRICE}) b WHERE block_id BETWEEN 4 AND 5")
def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "hybrid")
    materialize.write_partition(table(spark, sf, "orders"), path, ["o_totalprice", "o_orderkey"], [4, 5], ["o_orderkey", "o_totalprice"])
    return spark.read.parquet(path)


@_query("partition_block_folders", f"SELECT o_orderkey, o_orderdate FROM ({_block_sql('orders', ['o_orderdate', 'o_orderkey'], '*')}) b WHERE block_id IN (1, 10)")
def _folders(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "layout")
    materialize.write_layout(table(spark, sf, "orders"), path, "o_orderdate", ["o_orderkey"])
    return materialize.read_partition(spark, path, [1, 10], ["o_orderkey", "o_orderdate"])


_HITS_BY_DATE = f"SELECT DISTINCT block_id FROM ({_block_sql('orders', ['o_orderdate', 'o_orderkey'], 'o_orderkey')}) b WHERE o_orderkey IN ({WORKLOAD['urgent_spring'].hits['orders']})"


@_query("partition_range_predicate", f"SELECT min(block_id) AS first_block, max(block_id) AS last_block FROM (SELECT block_id, block_id - row_number() OVER (ORDER BY block_id) AS run FROM ({_HITS_BY_DATE}) d) r GROUP BY run")
def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    hits = run_sql(spark, sf, spark_sql(WORKLOAD["urgent_spring"].hits["orders"]))
    touched = blocks.touched_blocks(table(spark, sf, "orders"), hits, ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    return blocks.merged_ranges(touched)


@_query("hash_bucket_blocks", f"SELECT CAST(block_id % 3 AS INTEGER) AS part, count(*) AS n_blocks FROM ({_HITS_BY_DATE}) d GROUP BY block_id % 3")
def _bucket_blocks(spark: SparkSession, sf: str) -> DataFrame:
    hits = run_sql(spark, sf, spark_sql(WORKLOAD["urgent_spring"].hits["orders"]))
    touched = blocks.touched_blocks(table(spark, sf, "orders"), hits, ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    return touched.groupBy(F.pmod("block_id", F.lit(3)).cast("int").alias("part")).agg(F.count("*").alias("n_blocks"))


@_query("delimited_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _delimited(spark: SparkSession, sf: str) -> DataFrame:
    df, path = table(spark, sf, "supplier"), fresh_path(spark, "delimited")
    corpus.save_delimited(df, path)
    return corpus.load_delimited(spark, path, df.schema)


# lineage and encoding ------------------------------------------------------------------------------------------------

LINEAGE_QUERIES = {
    **{name: q.sql for name, q in WORKLOAD.items()},
    "cte_case_window": "WITH v AS (SELECT l_suppkey AS s, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem WHERE l_quantity > 5 GROUP BY l_suppkey) SELECT s_name, CASE WHEN s_acctbal > 0 THEN rev ELSE 0 END AS r, rank() OVER (PARTITION BY s_nationkey ORDER BY rev) AS k FROM supplier JOIN v ON s_suppkey = v.s",
    "union_derived": "SELECT d.k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_nationkey FROM supplier) d WHERE d.k IN (SELECT n_nationkey FROM nation WHERE n_name LIKE 'N%') ORDER BY d.k",
    "self_join": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey",
    "having_scalar": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT avg(p_retailprice) FROM part WHERE p_size > 3)",
}

_SELECT = {
    "urgent_spring": "orders.o_orderkey orders.o_totalprice",
    "big_spenders": "customer.c_name orders.o_totalprice",
    "segment_nation": "customer.c_nationkey",
    "small_promo": "part.p_partkey part.p_retailprice",
    "poor_suppliers": "supplier.s_name nation.n_name",
    "idle_customers": "customer.c_custkey",
    "cte_case_window": "supplier.s_name lineitem.l_extendedprice lineitem.l_discount",
    "union_derived": "customer.c_nationkey supplier.s_nationkey",
    "self_join": "nation.n_name",
    "having_scalar": "orders.o_custkey",
}
_WHERE = {
    "urgent_spring": "orders.o_orderdate orders.o_orderpriority",
    "big_spenders": "customer.c_custkey orders.o_custkey orders.o_totalprice customer.c_name",
    "segment_nation": "customer.c_mktsegment customer.c_nationkey",
    "small_promo": "part.p_size part.p_type part.p_retailprice",
    "poor_suppliers": "supplier.s_nationkey nation.n_nationkey supplier.s_acctbal",
    "idle_customers": "orders.o_custkey customer.c_custkey orders.o_totalprice",
    "cte_case_window": "lineitem.l_quantity lineitem.l_suppkey supplier.s_suppkey supplier.s_acctbal supplier.s_nationkey lineitem.l_extendedprice lineitem.l_discount",
    "union_derived": "customer.c_acctbal customer.c_nationkey supplier.s_nationkey nation.n_name",
    "self_join": "nation.n_regionkey nation.n_nationkey",
    "having_scalar": "orders.o_custkey orders.o_totalprice part.p_size",
}


def _expected(role: dict[str, str]) -> list[tuple]:
    return [(q, *c.split(".")) for q, cs in role.items() for c in cs.split()]


def _lineage(spark: SparkSession, sf: str, queries: dict[str, str] | None = None) -> DataFrame:
    register(spark, sf)
    return lineage_frame(spark, queries or LINEAGE_QUERIES)


@_query("lineage_select", f"SELECT query_id, table_name, column_name FROM {_values(_expected(_SELECT), 'query_id, table_name, column_name')}")
def _lineage_select(spark: SparkSession, sf: str) -> DataFrame:
    return _lineage(spark, sf).where("role = 'select'").drop("role")


@_query("lineage_where", f"SELECT query_id, table_name, column_name FROM {_values(_expected(_WHERE), 'query_id, table_name, column_name')}")
def _lineage_where(spark: SparkSession, sf: str) -> DataFrame:
    return _lineage(spark, sf).where("role = 'where'").drop("role")


_TABLES = {
    "urgent_spring": "orders", "big_spenders": "customer orders", "segment_nation": "customer", "small_promo": "part", "poor_suppliers": "supplier nation",
    "idle_customers": "customer orders", "cte_case_window": "lineitem supplier", "union_derived": "customer supplier nation", "self_join": "nation", "having_scalar": "orders part",
}


@_query("lineage_tables", f"SELECT query_id, table_name FROM {_values([(q, t) for q, ts in _TABLES.items() for t in ts.split()], 'query_id, table_name')}")
def _lineage_tables(spark: SparkSession, sf: str) -> DataFrame:
    return _lineage(spark, sf).where("role = 'table'").select("query_id", "table_name")


_PRUNABLE = {"urgent_spring": "orders", "big_spenders": "customer orders", "segment_nation": "customer", "small_promo": "part", "poor_suppliers": "supplier nation", "idle_customers": "customer", "cte_case_window": "supplier", "union_derived": "customer supplier", "self_join": "nation", "having_scalar": "orders"}


@_query("prunable_tables", f"SELECT query_id, table_name FROM {_values([(q, t) for q, ts in _PRUNABLE.items() for t in ts.split()], 'query_id, table_name')}")
def _prunable(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, sf)
    rows = [(q, t) for q, sql in LINEAGE_QUERIES.items() for t in sorted(prunable(spark, sql))]
    return spark.createDataFrame(rows, "query_id string, table_name string")


_ORDINALS = {t: i for i, t in enumerate(sorted(COLUMNS))}
_WORK_ROLES = [(q, role, *c.split(".")) for role, cs in (("select", _SELECT), ("where", _WHERE)) for q in WORKLOAD for c in cs[q].split()]
_ORDINAL_ROWS = [(t, _ORDINALS[t], c, i) for t, cs in COLUMNS.items() for i, c in enumerate(cs)]
_ENCODE_SQL = f"""
WITH o AS {_values(_ORDINAL_ROWS, 'table_name, t, column_name, c')},
w AS {_values(_WORK_ROLES, 'query_id, role, table_name, column_name')},
l AS (SELECT query_id, table_name, order_column, {_LIST} AS blocks FROM ({_locations_sql()}) u GROUP BY query_id, table_name, order_column),
r AS (SELECT * FROM w WHERE query_id IN (SELECT query_id FROM l)),
p AS (SELECT l.query_id, l.table_name, o.c AS order_c, l.blocks FROM l JOIN o ON o.table_name = l.table_name AND o.column_name = l.order_column)
SELECT r.query_id, r.role, CAST(o.t AS INTEGER) AS t, CAST(o.c AS INTEGER) AS c, CAST(NULL AS INTEGER) AS order_c, CAST(NULL AS VARCHAR) AS blocks FROM r JOIN o ON o.table_name = r.table_name AND o.column_name = r.column_name WHERE r.role = 'select'
UNION ALL
SELECT r.query_id, r.role, CAST(o.t AS INTEGER), CAST(o.c AS INTEGER), CAST(p.order_c AS INTEGER), p.blocks FROM r JOIN o ON o.table_name = r.table_name AND o.column_name = r.column_name LEFT JOIN p ON p.query_id = r.query_id AND p.table_name = r.table_name WHERE r.role = 'where'
"""


@_query("encode_workload", _ENCODE_SQL)
def _encode(spark: SparkSession, sf: str) -> DataFrame:
    found = _lineage(spark, sf, {n: q.sql for n, q in WORKLOAD.items()})
    tables = spark.createDataFrame(list(_ORDINALS.items()), "table_name string, t int")
    columns = spark.createDataFrame([(t, c, i) for t, _, c, i in _ORDINAL_ROWS], "table_name string, column_name string, c int")
    out = encode.encode(tables, columns, found, locations(spark, sf)).where("role != 'table'")
    return out.withColumn("blocks", F.when(F.col("blocks").isNotNull(), F.concat_ws(",", F.transform("blocks", lambda b: b.cast("string")))))


# cost model ----------------------------------------------------------------------------------------------------------

_FREQ = [("q1", 0.5), ("q2", 0.3), ("q3", 0.2)]
_SIZES = [("a", 100.0), ("b", 40.0)]
_NCOLS = {"a": 4, "b": 6}
_ROW_CUTS = [("a", 1), ("a", 3), ("b", 5)]
_COL_CUTS = [("a", 0), ("a", 1), ("a", 2), ("b", 2)]
_LOC = [("q1", "a", 2), ("q1", "a", 3), ("q2", "a", 9), ("q2", "b", 1), ("q2", "b", 6), ("q3", "b", 10), ("q3", "b", 9)]
_TARGETS = [("q1", "a", 0), ("q1", "a", 2), ("q2", "a", 1), ("q2", "b", 0), ("q2", "b", 5), ("q3", "b", 4)]
_COST_CTES = f"""
WITH freq AS {_values(_FREQ, 'query_id, freq')}, sizes AS {_values(_SIZES, 'table_name, size_mb')},
blk AS {_values([(t, b) for t in _NCOLS for b in range(1, 11)], 'table_name, pos')}, col AS {_values([(t, c) for t, n in _NCOLS.items() for c in range(n)], 'table_name, pos')},
rc AS {_values(_ROW_CUTS, 'table_name, pos')}, cc AS {_values(_COL_CUTS, 'table_name, pos')}, loc AS {_values(_LOC, 'query_id, table_name, pos')}, tgt AS {_values(_TARGETS, 'query_id, table_name, pos')},
rs AS (SELECT b.table_name, b.pos, 1 + (SELECT count(*) FROM rc WHERE rc.table_name = b.table_name AND rc.pos < b.pos) AS seg FROM blk b),
cs AS (SELECT b.table_name, b.pos, 1 + (SELECT count(*) FROM cc WHERE cc.table_name = b.table_name AND cc.pos < b.pos) AS seg FROM col b),
rh AS (SELECT DISTINCT l.query_id, l.table_name, rs.seg FROM loc l JOIN rs ON rs.table_name = l.table_name AND rs.pos = l.pos),
ch AS (SELECT DISTINCT l.query_id, l.table_name, cs.seg FROM tgt l JOIN cs ON cs.table_name = l.table_name AND cs.pos = l.pos),
rf AS (SELECT rh.query_id, rh.table_name, rs.pos, rs.seg FROM rh JOIN rs ON rs.table_name = rh.table_name AND rs.seg = rh.seg),
cf AS (SELECT ch.query_id, ch.table_name, cs.pos, cs.seg FROM ch JOIN cs ON cs.table_name = ch.table_name AND cs.seg = ch.seg),
rq AS (SELECT query_id, table_name, count(*) AS hit_rows, count(DISTINCT seg) AS row_segments, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS row_blocks FROM rf GROUP BY query_id, table_name),
cq AS (SELECT query_id, table_name, count(*) AS hit_cols, count(DISTINCT seg) AS col_segments, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS col_block FROM cf GROUP BY query_id, table_name),
byq AS (SELECT rq.query_id, rq.table_name, hit_rows, hit_cols, row_segments, col_segments, row_blocks, col_block, freq.freq, freq.freq * size_mb * hit_rows * hit_cols / (10 * (SELECT count(*) FROM col WHERE col.table_name = rq.table_name)) AS cost
        FROM rq JOIN cq ON cq.query_id = rq.query_id AND cq.table_name = rq.table_name JOIN sizes ON sizes.table_name = rq.table_name JOIN freq ON freq.query_id = rq.query_id)
"""


def _cost_inputs(spark: SparkSession) -> dict[str, DataFrame]:
    make = spark.createDataFrame
    return {
        "sizes": make(_SIZES, "table_name string, size_mb double"),
        "blocks": make([(t, b) for t in _NCOLS for b in range(1, 11)], "table_name string, block_id int"),
        "columns": make([(t, c) for t, n in _NCOLS.items() for c in range(n)], "table_name string, c int"),
        "row_cuts": make(_ROW_CUTS, "table_name string, block_id int"),
        "col_cuts": make(_COL_CUTS, "table_name string, c int"),
        "loc": make(_LOC, "query_id string, table_name string, block_id int"),
        "targets": make(_TARGETS, "query_id string, table_name string, c int"),
        "freq": make(_FREQ, "query_id string, freq double"),
    }


@_query("cost_by_query", _COST_CTES + "SELECT query_id, table_name, hit_rows, hit_cols, row_segments, col_segments, round(cost, 6) AS cost FROM byq")
def _cost_by_query(spark: SparkSession, sf: str) -> DataFrame:
    return costmodel.cost_frame(**_cost_inputs(spark)).withColumn("cost", F.round("cost", 6))


@_query("cost_layout", _COST_CTES + "SELECT table_name, round(sum(cost), 6) AS cost, round(sum(freq * row_segments * col_segments), 6) AS block_num FROM byq GROUP BY table_name")
def _cost_layout(spark: SparkSession, sf: str) -> DataFrame:
    inputs = _cost_inputs(spark)
    out = costmodel.table_cost(costmodel.cost_frame(**inputs), inputs["freq"])
    return out.select("table_name", F.round("cost", 6).alias("cost"), F.round("block_num", 6).alias("block_num"))


@_query("expand_layout", _COST_CTES + "SELECT query_id, table_name, row_blocks, col_block FROM byq")
def _expand_layout(spark: SparkSession, sf: str) -> DataFrame:
    inputs = _cost_inputs(spark)
    inputs.pop("sizes"), inputs.pop("freq")
    return _joined(_joined(costmodel.expand_frame(**inputs), "row_blocks"), "col_block")


@_query(
    "cost_hash_partitioning",
    f"""WITH loc AS {_values(_LOC, 'query_id, table_name, b')}, freq AS {_values(_FREQ, 'query_id, freq')}, sizes AS {_values(_SIZES, 'table_name, size_mb')},
h AS (SELECT DISTINCT query_id, table_name, b % 3 AS part FROM loc), n AS (SELECT query_id, table_name, sum(CASE WHEN part = 1 THEN 4 ELSE 3 END) AS n FROM h GROUP BY query_id, table_name)
SELECT n.query_id, n.table_name, round(freq * size_mb * n / 10, 6) AS cost FROM n JOIN freq ON freq.query_id = n.query_id JOIN sizes ON sizes.table_name = n.table_name""",
)
def _cost_hash(spark: SparkSession, sf: str) -> DataFrame:
    inputs = _cost_inputs(spark)
    return costmodel.hash_cost_frame(inputs["loc"], inputs["sizes"], inputs["freq"]).withColumn("cost", F.round("cost", 6))


# search, agent and recommendation ------------------------------------------------------------------------------------


def loads(spark: SparkSession, sf: str) -> dict[str, costmodel.TableLoad]:
    """What the workload touches, collected: one row per query, table and sort column."""
    found = _lineage(spark, sf, {n: q.sql for n, q in WORKLOAD.items()}).where("role != 'table'").collect()
    placed = locations(spark, sf).collect()
    sizes = catalog.catalog(spark, sf, tuple(KEYS))
    out = {}
    for t in KEYS:
        place = {c: i for i, c in enumerate(COLUMNS[t])}
        queries = sorted({r.query_id for r in placed if r.table_name == t})
        targets = {q: frozenset(place[r.column_name] for r in found if r.query_id == q and r.table_name == t) for q in queries}
        loc = {q: {place[r.order_column]: frozenset(r.blocks) for r in placed if r.query_id == q and r.table_name == t} for q in queries}
        out[t] = costmodel.TableLoad(sizes[t].size_mb, len(place), targets, loc, dict.fromkeys(queries, 1 / len(WORKLOAD)))
    return out


def _recommended(spark: SparkSession, found: dict[str, costmodel.TableLoad], layouts: dict[str, costmodel.Layout]) -> DataFrame:
    rows = []
    for t, load in found.items():
        got = costmodel.cost(load, layouts[t])
        for q in sorted(load.targets):
            b, c = costmodel.expand(load, layouts[t], q)
            key = layouts[t].sort_key
            rows.append((q, t, None if key is None else COLUMNS[t][key], b, [COLUMNS[t][i] for i in c], got.size, got.block_num, got.partition_num))
    return spark.createDataFrame(rows, "query_id string, table_name string, order_column string, blocks array<int>, columns array<string>, cost double, block_num double, partition_num int")


@_query("greedy_layout")
def _greedy(spark: SparkSession, sf: str) -> DataFrame:
    found = loads(spark, sf)
    return _recommended(spark, found, {t: search.greedy(load) for t, load in found.items()})


@_query("agent_layout")
def _agent(spark: SparkSession, sf: str) -> DataFrame:
    found = loads(spark, sf)
    agents, _ = agent.train(found, agent.Settings(episodes=6, hidden=64, rate=0.005))
    return _recommended(spark, found, agent.rollout(found, agents))


@_query("hash_agent_attributes")
def _hash_agent(spark: SparkSession, sf: str) -> DataFrame:
    rows = []
    for t, load in loads(spark, sf).items():
        by_key = {c: {q: load.loc[q][c] for q in load.loc} for c in range(load.n_columns)}
        chosen, cost = baselines.train_hash(baselines.HashEnvironment(by_key, load.freq, load.size_mb, load.n_columns), agent.Settings(episodes=25, hidden=32, rate=0.01))
        rows.append((t, [COLUMNS[t][c] for c in chosen], cost))
    return spark.createDataFrame(rows, "table_name string, attributes array<string>, cost double")


# evaluation ----------------------------------------------------------------------------------------------------------

_BIG = WORKLOAD["big_spenders"].sql.replace("sum(o_totalprice) AS total", "round(sum(o_totalprice), 2) AS total")


@_query("substituted_query", _BIG)
def _substituted(spark: SparkSession, sf: str) -> DataFrame:
    """The unchanged SQL over pruned relations: only the blocks that the query touches, without unused columns."""
    register(spark, sf)
    relations = {}
    for t, order in (("orders", "o_totalprice"), ("customer", "c_acctbal")):
        key = KEYS[t][0]
        hits = spark.sql(spark_sql(WORKLOAD["big_spenders"].hits[t]))
        rows = table(spark, sf, t)
        touched = [r.block_id for r in blocks.touched_blocks(rows, hits, [order, key], [key]).collect()]  # ten at most
        path = fresh_path(spark, "layout")
        materialize.write_layout(rows, path, order, [key])
        relations[t] = materialize.read_partition(spark, path, touched, [c for c in COLUMNS[t] if c not in ("o_orderpriority", "c_mktsegment")])
    evaluate.substitute(spark, _BIG, relations)
    out = spark.sql(_BIG)
    register(spark, sf)
    return out


_NAMES = sorted(WORKLOAD)
_USED = [(q, t) for q in _NAMES for t in _TABLES[q].split()]
_REL = [("orders", 12.5), ("customer", 3.25), ("part", 2.0), ("supplier", 0.5), ("nation", 0.125)]


@_query(
    "workload_scan_size",
    f"WITH w AS {_values([(i, _NAMES[i * i % len(_NAMES)]) for i in range(40)], 'position, query_id')}, u AS {_values(_USED, 'query_id, relation')}, s AS {_values(_REL, 'relation, size_mb')} SELECT round(sum(size_mb), 6) AS scan_mb FROM w JOIN u ON u.query_id = w.query_id JOIN s ON s.relation = u.relation",
)
def _scan_size(spark: SparkSession, sf: str) -> DataFrame:
    workload = spark.createDataFrame([(i, _NAMES[i * i % len(_NAMES)]) for i in range(40)], "position int, query_id string")
    out = evaluate.workload_scan_size(workload, spark.createDataFrame(_USED, "query_id string, relation string"), spark.createDataFrame(_REL, "relation string, size_mb double"))
    return out.select(F.round("scan_mb", 6).alias("scan_mb"))


@_query("scan_measurements")
def _measured(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, sf)
    rows = []
    for name, q in WORKLOAD.items():
        got = evaluate.scan_metrics(spark.sql(q.sql))
        rows.append((name, got["filesSize"], got["numFiles"], got["numOutputRows"], sum(evaluate.phase_ms(spark, q.sql).values())))
    return spark.createDataFrame(rows, "query_id string, scan_bytes long, files long, scan_rows long, plan_ms double")


_STATS = [(q, 1.5 * (i + 1), len(_SELECT[q].split()), len(_TABLES[q].split()), len(_WHERE[q].split())) for i, q in enumerate(_NAMES)]
_WORKLOADS = [(w, i, _NAMES[(w * 7 + i * i) % len(_NAMES)]) for w in range(12) for i in range(5 + 3 * w)]


@_query(
    "workload_features",
    f"WITH w AS {_values(_WORKLOADS, 'workload_id, position, query_id')}, q AS {_values(_STATS, 'query_id, parse_ms, n_select, n_from, n_where')} SELECT CAST(workload_id AS INTEGER) AS workload_id, count(*) AS workload_size, count(DISTINCT w.query_id) AS distinct_queries, round(sum(parse_ms), 6) AS parse_ms, CAST(sum(n_select) AS BIGINT) AS n_select, CAST(sum(n_from) AS BIGINT) AS n_from, CAST(sum(n_where) AS BIGINT) AS n_where, CAST(3.5 AS DOUBLE) AS block_size, CAST(7.0 AS DOUBLE) AS block_num, 12 AS partition_num FROM w JOIN q ON q.query_id = w.query_id GROUP BY workload_id",
)
def _features(spark: SparkSession, sf: str) -> DataFrame:
    layout = spark.createDataFrame([(3.5, 7.0, 12)], "block_size double, block_num double, partition_num int")
    out = perfmodel.workload_features(spark.createDataFrame(_WORKLOADS, "workload_id int, position int, query_id string"), spark.createDataFrame(_STATS, "query_id string, parse_ms double, n_select int, n_from int, n_where int"), layout)
    return out.withColumn("parse_ms", F.round("parse_ms", 6))


@_query("perf_regression")
def _regression(spark: SparkSession, sf: str) -> DataFrame:
    x = F.pmod(F.xxhash64("id"), F.lit(981)) + 20
    rows = spark.range(240).select(x.alias("workload_size"), (x / 7).alias("parse_ms"), (x * 2).alias("n_select"), F.lit(3.0).alias("block_size"), (x * 1.5 + F.pmod("id", F.lit(9))).alias("runtime"))
    fit = perfmodel.fit(rows, trees=10, depth=4, folds=0)
    return fit.predictions.withColumn("rmse", F.lit(fit.rmse)).withColumn("r2", F.lit(fit.r2))


# baselines -----------------------------------------------------------------------------------------------------------

_ATTR = [("q1", "a"), ("q1", "b"), ("q2", "a"), ("q2", "c"), ("q3", "b"), ("q3", "a"), ("q3", "b")]


@_query("frequent_attribute", f"WITH u AS {_values(_ATTR, 'query_id, column_name')}, f AS {_values(_FREQ, 'query_id, freq')} SELECT column_name, round(sum(freq) / (SELECT sum(freq) FROM f), 6) AS support FROM (SELECT DISTINCT * FROM u) d JOIN f ON f.query_id = d.query_id GROUP BY column_name HAVING sum(freq) / (SELECT sum(freq) FROM f) >= 0.5")
def _frequent(spark: SparkSession, sf: str) -> DataFrame:
    out = baselines.frequent_attributes(spark.createDataFrame(_ATTR, "query_id string, column_name string"), spark.createDataFrame(_FREQ, "query_id string, freq double"))
    return out.withColumn("support", F.round("support", 6))


_SEL_C = [("q1", 0), ("q1", 1), ("q2", 2), ("q3", 1)]
_WHR_C = [("q1", 1), ("q2", 0), ("q3", 1), ("q3", 3)]
_USAGE_SQL = f"""WITH s AS {_values(_SEL_C, 'query_id, c')}, w AS {_values(_WHR_C, 'query_id, c')}, f AS {_values(_FREQ, 'query_id, freq')}, col AS {_values([(i,) for i in range(5)], 'c')},
u AS (SELECT f.query_id, col.c, f.freq, CASE WHEN s.c IS NOT NULL AND w.c IS NOT NULL THEN CAST(1.0 AS DOUBLE) WHEN s.c IS NOT NULL OR w.c IS NOT NULL THEN f.freq ELSE CAST(0.0 AS DOUBLE) END AS p
      FROM f CROSS JOIN col LEFT JOIN s ON s.query_id = f.query_id AND s.c = col.c LEFT JOIN w ON w.query_id = f.query_id AND w.c = col.c)"""


def _usage(spark: SparkSession) -> DataFrame:
    make = spark.createDataFrame
    return baselines.usage(make(_SEL_C, "query_id string, c int"), make(_WHR_C, "query_id string, c int"), make(_FREQ, "query_id string, freq double"), make([(i,) for i in range(5)], "c int"))


@_query("affinity_matrix", _USAGE_SQL + " SELECT CAST(a.c AS INTEGER) AS i, CAST(b.c AS INTEGER) AS j, round(sum(CASE WHEN greatest(a.p, b.p) > 0 THEN a.freq * (a.p + b.p) / 2 / greatest(a.p, b.p) ELSE 0 END), 6) AS aff FROM u a JOIN u b ON a.query_id = b.query_id GROUP BY a.c, b.c")
def _affinity(spark: SparkSession, sf: str) -> DataFrame:
    return baselines.affinity(_usage(spark)).withColumn("aff", F.round("aff", 6))


_GROUPS = [(0, 0), (1, 0), (2, 1), (3, 2), (4, 1)]


@_query("affinity_column_block", f"WITH g AS {_values(_GROUPS, 'c, grp')}, t AS {_values(_SEL_C, 'query_id, c')}, h AS (SELECT DISTINCT t.query_id, g.grp FROM t JOIN g ON g.c = t.c) SELECT h.query_id, string_agg(CAST(g.c AS VARCHAR), ',' ORDER BY g.c) AS col_block FROM h JOIN g ON g.grp = h.grp GROUP BY h.query_id")
def _column_block(spark: SparkSession, sf: str) -> DataFrame:
    out = baselines.column_blocks(spark.createDataFrame(_GROUPS, "c int, grp int"), spark.createDataFrame(_SEL_C, "query_id string, c int"))
    return _joined(out, "col_block")


@_query("affinity_groups")
def _affinity_groups(spark: SparkSession, sf: str) -> DataFrame:
    import numpy as np

    matrix = np.zeros((5, 5))
    for r in baselines.affinity(_usage(spark)).collect():  # columns squared
        matrix[r.i, r.j] = r.aff
    return spark.createDataFrame(list(enumerate(baselines.affinity_groups(matrix))), "c int, grp int")


# arrival rates -------------------------------------------------------------------------------------------------------

_CYCLE = {200: [(40, 15, 100), (120, 30, 80)], 500: [(300, 100, 200)]}


def _bell(period: int, c: float, w: float, s: float) -> str:
    half = w / 2
    return f"{s} / (sqrt(2 * pi()) * {half}) * exp(-pow(t % {period} - {c}, 2) / (2 * {half} * {half}))"


@_query("arrival_cycle", "SELECT CAST(t AS BIGINT) AS t, round(30 + " + " + ".join(_bell(p, *c) for p, cs in _CYCLE.items() for c in cs) + ", 6) AS rate FROM range(3000) r(t)")
def _cycle(spark: SparkSession, sf: str) -> DataFrame:
    return arrival.steps(spark, 3000).select("t", F.round(arrival.cycle(F.col("t"), _CYCLE, 30), 6).alias("rate"))


@_query("arrival_stability", "SELECT CAST(t AS BIGINT) AS t, CAST(CASE WHEN t < 500 THEN 12.5 ELSE 0 END AS DOUBLE) AS rate FROM range(1000) r(t)")
def _stability(spark: SparkSession, sf: str) -> DataFrame:
    rate = F.when(F.col("t") < 500, arrival.stability(12.5)).otherwise(arrival.stability(-3))
    return arrival.steps(spark, 1000).select("t", rate.alias("rate"))


_SPIKES = [(1, 10, 50.0, 8), (1, 14, 20.0, 5), (2, 0, 30.0, 12), (2, 195, 9.0, 20)]


def _spike_sql(decay: str) -> str:
    return f"""WITH s AS {_values(_SPIKES, 'template_id, start, height, length')}, g AS (SELECT t, k.template_id FROM range(200) r(t) CROSS JOIN (VALUES (1), (2)) k(template_id))
SELECT CAST(g.template_id AS INTEGER) AS template_id, CAST(g.t AS BIGINT) AS t, round(5 + coalesce(sum(s.height * {decay}), 0), 6) AS rate FROM g LEFT JOIN s ON s.template_id = g.template_id AND g.t >= s.start AND g.t < s.start + s.length GROUP BY g.template_id, g.t"""


def _spiky(spark: SparkSession, shape: str) -> DataFrame:
    base = arrival.steps(spark, 200).join(spark.createDataFrame([(1,), (2,)], "template_id int"), how="cross").withColumn("rate", F.lit(5.0))
    out = arrival.add_spikes(base, spark.createDataFrame(_SPIKES, "template_id int, start long, height double, length int"), shape)
    return out.withColumn("rate", F.round("rate", 6))


@_query("arrival_spike_decay", _spike_sql("exp(-(g.t - s.start) / 3.0)"))
def _random_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return _spiky(spark, "random")


@_query("arrival_spike_cosine", _spike_sql("cos(pi() / (2 * s.length) * (g.t - s.start))"))
def _cosine_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return _spiky(spark, "cycle")


@_query("arrival_wide", "SELECT CAST(t * 5 AS BIGINT) AS time, round(" + _bell(200, 40, 15, 100) + ", 6) AS \"1\", round(" + _bell(200, 120, 30, 80) + ", 6) AS \"2\" FROM range(400) r(t)")
def _wide(spark: SparkSession, sf: str) -> DataFrame:
    t, steps = F.col("t"), arrival.steps(spark, 400)
    one = steps.select(F.lit(1).alias("template_id"), "t", F.round(arrival.component(F.pmod(t, F.lit(200)), 40, 15, 100), 6).alias("rate"))
    two = steps.select(F.lit(2).alias("template_id"), "t", F.round(arrival.component(F.pmod(t, F.lit(200)), 120, 30, 80), 6).alias("rate"))
    return arrival.wide(one.unionByName(two), [1, 2])


# forecasts -----------------------------------------------------------------------------------------------------------

_STEPS = 8640
_BINS_SQL = "SELECT event_type, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) // 300 AS t, count(*) AS n FROM events GROUP BY event_type, t"
_SERIES_SQL = f"""WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS template_id FROM (SELECT DISTINCT event_type FROM events) d),
b AS ({_BINS_SQL}), s AS (SELECT k.template_id, r.t, CAST(coalesce(b.n, 0) AS DOUBLE) AS rate FROM k CROSS JOIN range({_STEPS}) r(t) LEFT JOIN b ON b.event_type = k.event_type AND b.t = r.t)"""


def event_series(spark: SparkSession, sf: str) -> DataFrame:
    """(template_id, t, rate): events of each type by five-minute step of a month, with zeros."""
    events = table(spark, sf, "events").select("event_type", "ts")
    binned = events.groupBy("event_type", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) div 300").alias("t")).agg(F.count("*").alias("n"))
    kinds = [r.event_type for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    named = spark.createDataFrame(list(enumerate(kinds, 1)), "template_id long, event_type string")
    grid = arrival.steps(spark, _STEPS).join(F.broadcast(named), how="cross")
    return grid.join(binned, ["event_type", "t"], "left").select("template_id", "t", F.coalesce("n", F.lit(0)).cast("double").alias("rate"))


@_query("events_5min_rate", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY start, event_type")
def _event_rate(spark: SparkSession, sf: str) -> DataFrame:
    from stratum.streaming.rates import rates

    return rates(table(spark, sf, "events"))


@_query("zscore", _SERIES_SQL + " SELECT template_id, t, round((rate - avg(rate) OVER (PARTITION BY template_id)) / stddev_samp(rate) OVER (PARTITION BY template_id), 6) AS z FROM s")
def _zscore(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.normalized(event_series(spark, sf)).select("template_id", "t", F.round("z", 6).alias("z"))


@_query("zscore_population", _SERIES_SQL + " SELECT template_id, t, round((rate - avg(rate) OVER (PARTITION BY template_id)) / stddev_pop(rate) OVER (PARTITION BY template_id), 6) AS z FROM s")
def _zscore_population(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.normalized(event_series(spark, sf), population=True).select("template_id", "t", F.round("z", 6).alias("z"))


_SPLIT = int(_STEPS * forecast.WARM_UP)
_NAIVE_SQL = _SERIES_SQL + f", p AS (SELECT template_id, t + 288 AS t, rate FROM s WHERE t + 288 >= {_SPLIT} AND t + 288 < {_SPLIT} + 288 * 7), j AS (SELECT p.template_id, p.t, {_SPLIT} + (p.t - {_SPLIT}) // 288 * 288 AS origin, p.rate, s.rate AS actual FROM p JOIN s ON s.template_id = p.template_id AND s.t = p.t)"


def _naive(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The same time a day before, as a forecast to score."""
    series = event_series(spark, sf)
    shifted = series.select("template_id", (F.col("t") + 288).alias("t"), "rate").where(F.col("t").between(_SPLIT, _SPLIT + 288 * 7 - 1))
    return series, shifted.withColumn("origin", F.lit(_SPLIT) + F.floor((F.col("t") - _SPLIT) / 288) * 288)


@_query("forecast_score", _NAIVE_SQL + ", e AS (SELECT origin, template_id, avg(abs(rate - actual)) AS mae, avg(pow(rate - actual, 2)) AS mse FROM j GROUP BY origin, template_id) SELECT CAST(origin AS BIGINT) AS origin, round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse, round(sqrt(avg(mse)), 6) AS rmse FROM e GROUP BY origin")
def _score(spark: SparkSession, sf: str) -> DataFrame:
    out = forecast.score(*_naive(spark, sf))
    return out.select(F.col("origin").cast("long"), *[F.round(c, 6).alias(c) for c in ("mae", "mse", "rmse")])


@_query("forecast_means", _NAIVE_SQL + " SELECT template_id, round(avg(actual), 6) AS real_mean, round(avg(rate), 6) AS forecast_mean FROM j GROUP BY template_id")
def _means(spark: SparkSession, sf: str) -> DataFrame:
    out = forecast.real_and_forecast_means(*_naive(spark, sf))
    return out.select("template_id", F.round("real_mean", 6).alias("real_mean"), F.round("forecast_mean", 6).alias("forecast_mean"))


_USERS_SQL = "SELECT user_id AS template_id, count(*) / 8640.0 AS m FROM events GROUP BY user_id"


@_query("forecast_top10_others", f"WITH m AS ({_USERS_SQL}), r AS (SELECT template_id, m, row_number() OVER (ORDER BY m DESC, template_id) AS k FROM m) SELECT CAST(template_id AS VARCHAR) AS template, round(m, 6) AS mean_rate FROM r WHERE k <= 10 UNION ALL SELECT 'others', round(sum(m), 6) FROM r WHERE k > 10")
def _top(spark: SparkSession, sf: str) -> DataFrame:
    users = table(spark, sf, "events").groupBy(F.col("user_id").alias("template_id")).agg((F.count("*") / float(_STEPS)).alias("rate"))
    return forecast.top_and_others(users).withColumn("mean_rate", F.round("mean_rate", 6))


def _forecast(methods: dict[str, float]):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return forecast.rolling_forecast(event_series(spark, sf), methods, 288)

    return run


for _name in forecast.MODELS:
    QUERIES[f"forecast_{_name}"] = _forecast({_name: 1.0})
QUERIES["forecast_ensemble"] = _forecast({"linear": 0.5, "dlinear": 0.5})

# clusters ------------------------------------------------------------------------------------------------------------


def _hourly(spark: SparkSession, sf: str) -> DataFrame:
    """(template_id, t, rate): events of every user by hour of the day."""
    events = table(spark, sf, "events").select("user_id", "ts")
    counted = events.groupBy(F.col("user_id").alias("template_id"), F.hour("ts").cast("long").alias("t")).agg(F.count("*").alias("n"))
    grid = events.select(F.col("user_id").alias("template_id")).distinct().join(arrival.steps(spark, 24), how="cross")
    return grid.join(counted, ["template_id", "t"], "left").select("template_id", "t", F.coalesce("n", F.lit(0)).cast("double").alias("rate"))


_HOURLY_SQL = "WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT u.user_id AS template_id, r.t, CAST(count(e.event_id) AS DOUBLE) AS rate FROM u CROSS JOIN range(24) r(t) LEFT JOIN events e ON e.user_id = u.user_id AND EXTRACT(HOUR FROM e.ts) = r.t GROUP BY u.user_id, r.t)"


def _assigned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    series = _hourly(spark, sf)
    return series, series.select("template_id").distinct().withColumn("cluster", F.when(F.col("template_id") == 5, -1).otherwise(F.pmod("template_id", F.lit(3))))


@_query("cluster_centers", _HOURLY_SQL + " SELECT CAST(template_id % 3 AS BIGINT) AS cluster, CAST(23 - t AS BIGINT) AS back, sum(rate) AS total FROM s WHERE template_id <> 5 GROUP BY template_id % 3, t")
def _centers(spark: SparkSession, sf: str) -> DataFrame:
    out = cluster.centers(*_assigned(spark, sf))
    return out.select(F.col("cluster").cast("long"), F.col("back").cast("long"), "total")


@_query("cluster_center_trace", _HOURLY_SQL + " SELECT CAST(template_id % 3 AS BIGINT) AS cluster, CAST(24 - t AS BIGINT) AS back, sum(rate) AS total FROM s WHERE template_id <> 5 GROUP BY template_id % 3, t UNION ALL SELECT CAST(template_id % 3 AS BIGINT), 0, sum(rate) FROM s WHERE template_id <> 5 AND t = 0 GROUP BY template_id % 3")
def _trace(spark: SparkSession, sf: str) -> DataFrame:
    series, assigned = _assigned(spark, sf)
    newest = series.where("t = 0").select("template_id", "rate")
    out = cluster.add_newest(cluster.centers(series, assigned), newest, assigned)
    return out.select(F.col("cluster").cast("long"), F.col("back").cast("long"), "total")
