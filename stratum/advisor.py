"""The advisor end to end: profile, locate, search, lay out, run.

    advisor = Advisor(spark, folder, queries, keys)
    layouts = advisor.recommend()                # or method="agent", "exhaustive"
    advisor.materialize(layouts, path)
    advisor.run("q1")                            # the unchanged query over its pruned relations
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from stratum.operators import agent, blocks, evaluate, materialize, search
from stratum.operators.costmodel import BLOCKS, Cost, Layout, TableLoad, cost, expand
from stratum.plans import provenance
from stratum.plans.lineage import Lineage, lineage
from stratum.plans.views import register, table
from stratum.sources.catalog import TableInfo, catalog


class Advisor:
    """Advises layouts for the tables of a folder that have known row keys.

    queries: name -> SQL over the tables' names; keys: table -> columns that identify a row; freq: name -> weight,
    uniform if not given.
    """

    def __init__(self, spark: SparkSession, folder: str, queries: Mapping[str, str], keys: Mapping[str, Sequence[str]], freq: Mapping[str, float] | None = None, blocks_per_table: int = BLOCKS):
        self.spark, self.folder, self.queries, self.keys = spark, folder, dict(queries), {t: list(k) for t, k in keys.items()}
        self.freq = dict(freq) if freq else dict.fromkeys(self.queries, 1 / max(1, len(self.queries)))
        self.n_blocks = blocks_per_table
        register(spark, folder)
        self.tables: dict[str, TableInfo] = catalog(spark, folder, tuple(self.keys))
        self.lineage: dict[str, Lineage] = {q: lineage(spark, sql) for q, sql in self.queries.items()}
        self._loads: dict[str, TableLoad] | None = None
        self.layouts: dict[str, Layout] = {}
        self.path = ""

    def locations(self) -> DataFrame:
        """(query_id, table_name, order_column, blocks) for all queries, tables and sort columns."""
        tables = {t: (table(self.spark, self.folder, t), self.tables[t].columns, self.keys[t]) for t in self.keys}
        return blocks.locations_many(tables, {q: provenance.hits(self.spark, sql, self.keys) for q, sql in self.queries.items()}, self.n_blocks)

    def loads(self) -> dict[str, TableLoad]:
        """What each table's queries touch; computed once."""
        if self._loads is None:
            placed, self._loads = self.locations().collect(), {}  # a row per query, table and sort column
            for t, info in self.tables.items():
                at = {c: i for i, c in enumerate(info.columns)}
                used = {q: frozenset(at[c] for name, c in found.select | found.where if name == t) for q, found in self.lineage.items()}
                used = {q: cols for q, cols in used.items() if cols}
                loc = {q: {at[r.order_column]: frozenset(r.blocks) for r in placed if r.query_id == q and r.table_name == t} for q in used}
                if used:
                    self._loads[t] = TableLoad(info.size_mb, len(at), used, loc, {q: self.freq[q] for q in used}, self.n_blocks)
        return self._loads

    def recommend(self, method: str = "greedy", budget: int = search.BUDGET, settings: agent.Settings = agent.Settings()) -> dict[str, Layout]:
        """A layout for each table that queries touch."""
        loads = self.loads()
        if method == "agent":
            trained, _ = agent.train(loads, settings, budget)
            self.layouts = agent.rollout(loads, trained, budget)
        else:
            find = {"greedy": search.greedy, "exhaustive": search.exhaustive}[method]
            self.layouts = {t: find(load, budget) for t, load in loads.items()}
        return self.layouts

    def costs(self) -> dict[str, Cost]:
        return {t: cost(load, self.layouts[t]) for t, load in self.loads().items()}

    def materialize(self, layouts: Mapping[str, Layout], path: str) -> None:
        """Writes each table once, in block folders under its sort key."""
        self.layouts, self.path = dict(layouts), path.rstrip("/")
        for t, layout in self.layouts.items():
            if layout.sort_key is not None:
                materialize.write_layout(table(self.spark, self.folder, t), f"{self.path}/{t}", self.tables[t].columns[layout.sort_key], self.keys[t], self.n_blocks)

    def relations(self, query: str) -> dict[str, DataFrame]:
        """The blocks and columns that a query's partition of each laid-out table holds."""
        out = {}
        for t, layout in self.layouts.items():
            load = self.loads()[t]
            if query in load.targets and layout.sort_key is not None:
                rows, cols = expand(load, layout, query)
                out[t] = materialize.read_partition(self.spark, f"{self.path}/{t}", rows, [self.tables[t].columns[c] for c in cols])
        return out

    def run(self, query: str, original: bool = False) -> DataFrame:
        """The query's result over its relations (where they may stand for their tables), or over the original tables."""
        register(self.spark, self.folder)
        if not original:
            evaluate.substitute(self.spark, self.queries[query], self.relations(query))
        try:
            return self.spark.sql(self.queries[query])
        finally:
            register(self.spark, self.folder)

    def compare(self) -> DataFrame:
        """(query_id, before_bytes, after_bytes): bytes of the files that each query's scans open."""
        rows = []
        for q in self.queries:
            before, after = (evaluate.scan_metrics(self.run(q, original))["filesSize"] for original in (True, False))
            rows.append((q, before, after))
        return self.spark.createDataFrame(rows, "query_id string, before_bytes long, after_bytes long")

    def experiment(self, sizes: Sequence[int] = evaluate.SIZES, seed: int = 0) -> DataFrame:
        """(size, before_mb, after_mb): bytes that sampled workloads scan, each occurrence counted."""
        per = {r.query_id: (r.before_bytes, r.after_bytes) for r in self.compare().collect()}  # one row per query
        rows = []
        for size in sizes:
            drawn = evaluate.sample_workload(self.spark, sorted(self.queries), size, seed).groupBy("query_id").count().collect()
            rows.append((size, *(sum(per[r.query_id][k] * r["count"] for r in drawn) / 1024.0 / 1024.0 for k in (0, 1))))
        return self.spark.createDataFrame(rows, "size int, before_mb double, after_mb double")
