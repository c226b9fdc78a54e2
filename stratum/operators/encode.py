"""Workload encoding: names to ordinals, joined from catalog, lineage and locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def encode(tables: DataFrame, columns: DataFrame, lineage: DataFrame, locations: DataFrame) -> DataFrame:
    """(query_id, role, t, c, order_c, blocks) with 0-based ordinals.

    tables: (table_name, t); columns: (table_name, column_name, c); lineage and locations as those operators give
    them. Only queries with locations are kept; a where column carries every location of its table.
    """
    located = locations.select("query_id").distinct()
    known = columns.join(tables, "table_name")
    base = lineage.where(F.col("role") != "table").join(located, "query_id", "left_semi").join(known, ["table_name", "column_name"])
    order = known.select("table_name", F.col("column_name").alias("order_column"), F.col("c").alias("order_c"))
    placed = locations.join(order, ["table_name", "order_column"])
    where = base.where("role = 'where'").join(placed.select("query_id", "table_name", "order_c", "blocks"), ["query_id", "table_name"], "left")
    select = base.where("role = 'select'").withColumn("order_c", F.lit(None).cast("int")).withColumn("blocks", F.lit(None).cast("array<int>"))
    names = ["query_id", "role", "t", "c", "order_c", "blocks"]
    listed = lineage.where("role = 'table'").join(located, "query_id", "left_semi").join(tables, "table_name")
    listed = listed.select("query_id", "role", "t", F.lit(None).cast("int").alias("c"), F.lit(None).cast("int").alias("order_c"), F.lit(None).cast("array<int>").alias("blocks"))
    return select.select(*names).unionByName(where.select(*names)).unionByName(listed)
