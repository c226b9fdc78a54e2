"""Registered queries that show single steps of the advisor on the tables, each beside DuckDB SQL where SQL can express it."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import arrival
from stratum.operators import cluster, costmodel, evaluate, forecast, materialize, perfmodel
from stratum.plans import core_queries as core
from stratum.plans import provenance
from stratum.plans.store import fresh_path
from stratum.plans.views import register, table
from stratum.plans.workload import KEYS, WORKLOAD
from stratum.sources import corpus

_query, _values = core._query, core._values

# layouts -------------------------------------------------------------------------------------------------------------

_TARGETS = sorted({(q, *c.split(".")) for role in (core._SELECT, core._WHERE) for q in WORKLOAD for c in role[q].split()})
_LOADS_SQL = f"""WITH l AS ({core._locations_sql()}), t AS {_values(_TARGETS, 'query_id, table_name, column_name')},
w AS {_values([(t, len(core.COLUMNS[t])) for t in KEYS], 'table_name, width')}, n AS (SELECT DISTINCT query_id, table_name, order_column, block_id FROM l),
b AS (SELECT query_id, table_name, order_column, count(*) AS hit_rows FROM n GROUP BY query_id, table_name, order_column),
c AS (SELECT query_id, table_name, count(*) AS hit_cols FROM t GROUP BY query_id, table_name)"""


@_query("layout_cost_by_key", _LOADS_SQL + f" SELECT b.table_name, b.order_column, round(sum(hit_rows * hit_cols / (10.0 * width)) / {len(WORKLOAD)}, 6) AS fine, round(count(*) * 1.0 / {len(WORKLOAD)}, 6) AS whole FROM b JOIN c ON c.query_id = b.query_id AND c.table_name = b.table_name JOIN w ON w.table_name = b.table_name GROUP BY b.table_name, b.order_column")
def _cost_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """What the workload reads of each table, as a share of its size, under every sort key: with all cuts made and with none."""
    rows = []
    for t, load in core.loads(spark, sf).items():
        one = costmodel.TableLoad(1.0, load.n_columns, load.targets, load.loc, load.freq)
        for c, name in enumerate(core.COLUMNS[t]):
            fine = costmodel.Layout(c, frozenset(range(1, load.blocks)), frozenset(range(load.n_columns - 1)))
            rows.append((t, name, round(costmodel.cost(one, fine).size, 6), round(costmodel.cost(one, costmodel.Layout(c)).size, 6)))
    return spark.createDataFrame(rows, "table_name string, order_column string, fine double, whole double")


@_query("dropped_partition", f"SELECT o_orderkey, o_totalprice FROM ({core._ORDERS_BY_PRICE}) b WHERE block_id <> 4")
def _dropped(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "layout")
    materialize.write_layout(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, "o_totalprice", ["o_orderkey"])
    materialize.release(spark, f"{path}/block_id=4")
    return materialize.read_partition(spark, path)


@_query("partition_names", "SELECT * FROM (VALUES ('advisor', 'orders_q1_p'), ('drl_h', 'orders_q1_p0'), ('heuristic_h', 'orders_q1_p1'), ('heuristic_v', 'orders_q1_p2')) v(method, relation)")
def _names(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(m, materialize.partition_name("orders", "q1", m)) for m in materialize.SUFFIX], "method string, relation string")


_MD5 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@_query("hash_partitions", f"SELECT CAST({_MD5.format('CAST(o_custkey AS VARCHAR)')} % 3 AS INTEGER) AS part, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders GROUP BY part")
def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize.hash_partition_rows(table(spark, sf, "orders"), ["o_custkey"], digest=True)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("o_custkey").cast("long").alias("keys"))


# provenance and corpus -----------------------------------------------------------------------------------------------

_HIT_SQL = " UNION ALL ".join(f"SELECT '{q}' AS query_id, '{t}' AS table_name, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (SELECT DISTINCT {KEYS[t][0]} AS k FROM ({sql}) h) d" for q, w in WORKLOAD.items() for t, sql in w.hits.items())


@_query("result_keys", _HIT_SQL)
def _result_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The keys of the rows that each query touches, told from its plan without changing its text."""
    register(spark, sf)
    out = []
    for q, w in WORKLOAD.items():
        for t, keys in provenance.hits(spark, w.sql, KEYS).items():
            out.append(keys.agg(F.lit(q).alias("query_id"), F.lit(t).alias("table_name"), F.count("*").alias("n"), F.sum(KEYS[t][0]).cast("long").alias("keys")))
    return functools.reduce(DataFrame.unionByName, out)


_BIG = "c_custkey, c_name, c_nationkey, c_acctbal, o_orderkey, o_totalprice, o_orderdate"


@_query("star_rewrite", f"SELECT {_BIG} FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 290000")
def _star(spark: SparkSession, sf: str) -> DataFrame:
    register(spark, sf)
    return provenance.star(spark, WORKLOAD["big_spenders"].sql).select(*_BIG.split(", "))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


@_query("corpus_reader", f"SELECT query_id, sql FROM {_values([(q, ' '.join(w.sql.split())) for q, w in WORKLOAD.items()], 'query_id, sql')}")
def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_path(spark, "corpus")
    for q, w in WORKLOAD.items():
        _write_text(spark, f"{folder}/{q}.sql", "\n " + w.sql.replace(" FROM ", "\n  FROM\t").replace(" WHERE ", "\nWHERE ") + " ;\n")
    return corpus.sql_corpus(spark, folder)


@_query("feature_csv", core.ORACLE_SQL["workload_features"])
def _feature_csv(spark: SparkSession, sf: str) -> DataFrame:
    features, path = core.QUERIES["workload_features"](spark, sf), fresh_path(spark, "features")
    corpus.save_csv(features, path)
    return corpus.load_csv(spark, path, features.schema)


# evaluation ----------------------------------------------------------------------------------------------------------

_NAMES = sorted(WORKLOAD)
_DRAWN_SQL = f"WITH q AS {_values(list(enumerate(_NAMES)), 'pick, query_id')}, r AS (SELECT size, unnest(range(size)) AS position FROM (SELECT unnest([{', '.join(map(str, evaluate.SIZES))}]) AS size) s), d AS (SELECT size, position, {_MD5.format("'1:' || CAST(position AS VARCHAR)")} % {len(_NAMES)} AS pick FROM r)"


@_query("sampled_workload", _DRAWN_SQL + " SELECT CAST(position AS BIGINT) AS position, query_id FROM d JOIN q ON q.pick = d.pick WHERE size = 200")
def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.sample_workload(spark, _NAMES, 200, seed=1)


@_query("workload_sizes", _DRAWN_SQL + " SELECT CAST(size AS INTEGER) AS size, query_id, count(*) AS n FROM d JOIN q ON q.pick = d.pick GROUP BY size, query_id")
def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How often each query is drawn for each of the compared workload sizes."""
    drawn = [evaluate.sample_workload(spark, _NAMES, n, seed=1).groupBy("query_id").agg(F.count("*").alias("n")).withColumn("size", F.lit(n)) for n in evaluate.SIZES]
    return functools.reduce(DataFrame.unionByName, drawn).select("size", "query_id", "n")


@_query("workload_run_ms")
def _run_ms(spark: SparkSession, sf: str) -> DataFrame:
    """Mean run time of each workload size: each query is timed three times, and counts as often as it was drawn."""
    register(spark, sf)
    took = spark.createDataFrame([(q, evaluate.run_ms(spark, [WORKLOAD[q].sql])) for q in _NAMES], "query_id string, ms double")
    return _sizes(spark, sf).join(took, "query_id").groupBy("size").agg(F.sum(F.col("n") * F.col("ms")).alias("run_ms"))


@_query("perf_curve")
def _curve(spark: SparkSession, sf: str) -> DataFrame:
    """Loss of the run-time model after each tree, on measured workloads: plan time and run time of the drawn queries."""
    register(spark, sf)
    stats = [(q, sum(evaluate.phase_ms(spark, w.sql).values()), len(core._SELECT[q].split()), len(core._TABLES[q].split()), len(core._WHERE[q].split()), evaluate.run_ms(spark, [w.sql], 1)) for q, w in WORKLOAD.items()]
    stats = spark.createDataFrame(stats, "query_id string, parse_ms double, n_select int, n_from int, n_where int, ms double")
    drawn = [evaluate.sample_workload(spark, _NAMES, 20 + 7 * k, seed=k).withColumn("workload_id", F.lit(k)) for k in range(60)]
    drawn = functools.reduce(DataFrame.unionByName, drawn)
    layout = spark.createDataFrame([(1.0, 10.0, 1)], "block_size double, block_num double, partition_num int")
    run = drawn.join(stats, "query_id").groupBy("workload_id").agg(F.sum("ms").alias("runtime"))
    samples = perfmodel.workload_features(drawn, stats.drop("ms"), layout).join(run, "workload_id")
    fit = perfmodel.fit(samples.coalesce(1).cache(), trees=20, depth=4, folds=0)
    return spark.createDataFrame(fit.curve, "tree int, loss double")


# baselines -----------------------------------------------------------------------------------------------------------


def _itemset_sql() -> str:
    """Sets of up to three columns; a query stands for as many transactions as its frequency has hundredths."""
    base = f"WITH u AS (SELECT DISTINCT * FROM {_values(core._ATTR, 'query_id, c')} a), f AS (SELECT query_id, greatest(1, CAST(floor(freq * 100) AS INTEGER)) AS n FROM {_values(core._FREQ, 'query_id, freq')} f), k AS (SELECT sum(n) AS total FROM f WHERE query_id IN (SELECT query_id FROM u))"
    parts = []
    for size in (1, 2, 3):
        names = [f"u{i}" for i in range(size)]
        items = " || ',' || ".join(f"{x}.c" for x in names)
        joins = " ".join(f"JOIN u {b} ON {b}.query_id = {a}.query_id AND {b}.c > {a}.c" for a, b in zip(names, names[1:], strict=False))
        parts.append(f"SELECT {items} AS items, CAST(sum(f.n) AS BIGINT) AS freq FROM u u0 {joins} JOIN f ON f.query_id = u0.query_id GROUP BY 1 HAVING sum(f.n) >= {core.baselines.SUPPORT} * (SELECT total FROM k)")
    return base + " " + " UNION ALL ".join(parts)


@_query("frequent_itemsets", _itemset_sql())
def _itemsets(spark: SparkSession, sf: str) -> DataFrame:
    make = spark.createDataFrame
    found = core.baselines.frequent_itemsets(make(core._ATTR, "query_id string, column_name string"), make(core._FREQ, "query_id string, freq double"))
    return found.select(F.concat_ws(",", F.array_sort("items")).alias("items"), "freq")


# arrivals and forecasts ----------------------------------------------------------------------------------------------

_PATTERNS = arrival.sample_patterns(99, arrival.WEEK, seed=3)


def _patterns_sql() -> str:
    base = _values([(p.template_id, p.bias, p.kind) for p in _PATTERNS], "template_id, bias, kind")
    peaks = _values([(p.template_id, int(period), *map(float, c)) for p in _PATTERNS for period, cs in p.parts.items() for c in cs], "template_id, period, center, width, scale")
    spikes = _values([(p.template_id, int(s), float(h), int(n)) for p in _PATTERNS for s, h, n in p.spikes], "template_id, start, height, length")
    bell = "scale / (sqrt(2 * pi()) * (width / 2)) * exp(-pow(t % period - center, 2) / (2 * (width / 2) * (width / 2)))"
    shape = "s.height * CASE WHEN b.kind = 'spike_random' THEN exp(-(g.t - s.start) / 3.0) ELSE cos(pi() / (2 * s.length) * (g.t - s.start)) END"
    return f"""WITH b AS {base}, pk AS {peaks}, sp AS {spikes}, g AS (SELECT template_id, bias, kind, t FROM b CROSS JOIN range({arrival.WEEK}) r(t)),
pe AS (SELECT template_id, t, sum({bell}) AS x FROM pk CROSS JOIN range({arrival.WEEK}) r(t) GROUP BY template_id, t),
se AS (SELECT g.template_id, g.t, sum({shape}) AS x FROM g JOIN b ON b.template_id = g.template_id JOIN sp s ON s.template_id = g.template_id AND g.t >= s.start AND g.t < s.start + s.length GROUP BY g.template_id, g.t)
SELECT CAST(g.template_id AS INTEGER) AS template_id, CAST(g.t AS BIGINT) AS t, round(greatest(0, g.bias + coalesce(pe.x, 0) + coalesce(se.x, 0)), 6) AS rate
FROM g LEFT JOIN pe ON pe.template_id = g.template_id AND pe.t = g.t LEFT JOIN se ON se.template_id = g.template_id AND se.t = g.t"""


@_query("arrival_patterns", _patterns_sql())
def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    """All 99 templates of all kinds over a week, without noise."""
    out = arrival.arrival_rates(spark, _PATTERNS, arrival.WEEK, noisy=False)
    return out.select("template_id", "t", F.round("rate", 6).alias("rate"))


@_query("arrival_generated")
def _generated(spark: SparkSession, sf: str) -> DataFrame:
    return arrival.arrival_rates(spark, _PATTERNS, arrival.WEEK, seed=3)


@_query("zscore_inverse", core._SERIES_SQL + " SELECT template_id, t, round(rate, 6) AS rate FROM s")
def _inverse(spark: SparkSession, sf: str) -> DataFrame:
    z = forecast.normalized(core.event_series(spark, sf))
    stats = z.groupBy("template_id").agg(F.first("mean").alias("mean"), F.first("std").alias("std"))
    return forecast.denormalized(z.select("template_id", "t", "z"), stats).select("template_id", "t", F.round("rate", 6).alias("rate"))


# Two lags and a constant by the normal equations (with the operator's ridge), solved by determinants, then rolled
# forward step by step from each origin.
_HORIZON = 288
_ORIGINS = list(range(core._SPLIT, core._STEPS - forecast.LOOK_BACK, _HORIZON))
_LINEAR_SQL = core._SERIES_SQL.replace("WITH k", "WITH RECURSIVE k", 1) + f""", m AS (SELECT template_id, avg(rate) AS mean, stddev_samp(rate) AS std FROM s WHERE t < {core._SPLIT} GROUP BY template_id),
z AS (SELECT s.template_id, s.t, CASE WHEN std > 0 THEN (rate - mean) / std ELSE 0 END AS z FROM s JOIN m ON m.template_id = s.template_id),
x AS (SELECT a.template_id, a.z AS p, b.z AS q, c.z AS y FROM z a JOIN z b ON b.template_id = a.template_id AND b.t = a.t + 1 JOIN z c ON c.template_id = a.template_id AND c.t = a.t + 2 WHERE a.t + 2 < {core._SPLIT}),
e AS (SELECT template_id, sum(p * p) + 1e-6 AS a, sum(p * q) AS b, sum(p) AS c, sum(q * q) + 1e-6 AS d, sum(q) AS f, count(*) + 1e-6 AS g, sum(p * y) AS u, sum(q * y) AS v, sum(y) AS w FROM x GROUP BY template_id),
h AS (SELECT *, a * (d * g - f * f) - b * (b * g - f * c) + c * (b * f - d * c) AS det FROM e),
k3 AS (SELECT template_id, (u * (d * g - f * f) - b * (v * g - f * w) + c * (v * f - d * w)) / det AS k1, (a * (v * g - f * w) - u * (b * g - f * c) + c * (b * w - v * c)) / det AS k2, (a * (d * w - v * f) - b * (b * w - v * c) + u * (b * f - d * c)) / det AS k0 FROM h),
o AS (SELECT k3.*, i.origin, l.z AS before, r.z AS last FROM k3 CROSS JOIN (SELECT unnest({_ORIGINS}) AS origin) i JOIN z l ON l.template_id = k3.template_id AND l.t = i.origin - 2 JOIN z r ON r.template_id = k3.template_id AND r.t = i.origin - 1),
roll AS (SELECT template_id, origin, k0, k1, k2, 0 AS step, last AS before, k1 * before + k2 * last + k0 AS z FROM o
         UNION ALL SELECT template_id, origin, k0, k1, k2, step + 1, z, k1 * before + k2 * z + k0 FROM roll WHERE step + 1 < {_HORIZON} AND origin + step + 1 < {core._STEPS})
SELECT roll.template_id, CAST(origin AS BIGINT) AS origin, CAST(origin + step AS BIGINT) AS t, round(z * std + mean, 6) AS rate, round(z, 6) AS z FROM roll JOIN m ON m.template_id = roll.template_id"""


@_query("forecast_linear", _LINEAR_SQL)
def _linear(spark: SparkSession, sf: str) -> DataFrame:
    out = forecast.rolling_forecast(core.event_series(spark, sf), {"linear": 1.0}, _HORIZON)
    return out.withColumn("rate", F.round("rate", 6)).withColumn("z", F.round("z", 6))


@_query("forecast_models_score")
def _models_score(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of every model over the rolling origins, and of the same time a day before."""
    series, naive = core._naive(spark, sf)
    parts = [(name, core.QUERIES[f"forecast_{name}"](spark, sf)) for name in forecast.MODELS] + [("naive", naive)]
    scored = [forecast.mean_score(forecast.score(series, got)).withColumn("model", F.lit(name)) for name, got in parts]
    return functools.reduce(DataFrame.unionByName, scored).select("model", "mae", "mse", "rmse")


@_query("horizon_sweep")
def _sweep(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.horizon_sweep(core.event_series(spark, sf), {"linear": 1.0})


# clusters ------------------------------------------------------------------------------------------------------------

_RHO = 1.2
# the table of each pair is filled by anti-diagonals, of which a row of the recursion holds the last two
_DTW_SQL = core._HOURLY_SQL.replace("WITH u", "WITH RECURSIVE u", 1) + f""", f AS (SELECT template_id, list(rate ORDER BY t) AS x, sqrt(sum(rate * rate)) AS norm FROM s GROUP BY template_id),
g AS (SELECT template_id, CASE WHEN norm > 0 THEN list_transform(x, lambda v: v / norm) ELSE x END AS x FROM f),
p AS (SELECT a.template_id AS a, b.template_id AS b, a.x AS x, b.x AS y FROM g a JOIN g b ON a.template_id < b.template_id),
r AS (SELECT a, b, x, y, 0 AS d, list_transform(range(25), lambda i: 'infinity'::DOUBLE) AS old, list_transform(range(25), lambda i: CASE WHEN i = 1 THEN abs(x[1] - y[1]) ELSE 'infinity'::DOUBLE END) AS last FROM p
      UNION ALL SELECT a, b, x, y, d + 1, last, list_transform(range(25), lambda i: CASE WHEN i >= 1 AND d + 3 - i BETWEEN 1 AND 24 THEN abs(x[i] - y[d + 3 - i]) + least(last[i], last[i + 1], old[i]) ELSE 'infinity'::DOUBLE END) FROM r WHERE d < 46),
near AS (SELECT a, b, last[25] AS distance FROM r WHERE d = 46 AND last[25] < {_RHO})"""


@_query("dtw_pairs", _DTW_SQL + " SELECT a, b, round(distance, 6) AS distance FROM near")
def _dtw(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.neighbours(cluster.features(core._hourly(spark, sf)), _RHO).withColumn("distance", F.round("distance", 6))


@_query("dbscan_clusters", _DTW_SQL + ", ab AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), reach AS (SELECT template_id, template_id AS r FROM g UNION SELECT reach.template_id, ab.b FROM reach JOIN ab ON ab.a = reach.r) SELECT template_id, CAST(min(r) AS BIGINT) AS cluster FROM reach GROUP BY template_id")
def _dbscan(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster(cluster.features(core._hourly(spark, sf)), _RHO)


@_query("cluster_adjusted")
def _adjusted(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of the event types kept up from day to day: each round sees one more day of hourly counts."""
    hours = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").cast("double").alias("n"))
    rows = hours.groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "n"))), lambda x: x["n"]).alias("x")).orderBy("event_type").collect()  # a series a type
    held, out = cluster.ClusterState(rho=8.0, bound=24, last=72), []
    for day in range(1, 8):
        held.adjust({i: np.array(r["x"][: 24 * day]) for i, r in enumerate(rows)})
        out += [(day, rows[i]["event_type"], c) for i, c in sorted(held.assigned.items())]
    return spark.createDataFrame(out, "day int, event_type string, cluster int")


QUERIES, ORACLE_SQL = core.QUERIES, core.ORACLE_SQL
