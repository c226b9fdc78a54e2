"""Scan-size cost of a layout: a sort key, cuts between row blocks and cuts between columns.

Cuts split the B blocks and the C columns of a table into contiguous segments. A query reads the row segments that
hold one of its blocks under the sort key, and of those the column segments that hold one of its columns:

    cost(table) = sum over queries of freq * S * hit_rows * hit_columns / (B * C)

Both a driver form (the search calls it thousands of times on tiny matrices) and a DataFrame form are given.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCKS = 10


@dataclass(frozen=True)
class Layout:
    """sort_key: ordinal of the column or None; row_cuts after block 1..B-1; col_cuts after column 0..C-2."""

    sort_key: int | None = None
    row_cuts: frozenset[int] = frozenset()
    col_cuts: frozenset[int] = frozenset()


@dataclass(frozen=True)
class TableLoad:
    """What a table's queries touch. loc[q][sort_key] are blocks; targets[q] are column ordinals; freq[q] weights."""

    size_mb: float
    n_columns: int
    targets: dict[str, frozenset[int]] = field(default_factory=dict)
    loc: dict[str, dict[int, frozenset[int]]] = field(default_factory=dict)
    freq: dict[str, float] = field(default_factory=dict)
    blocks: int = BLOCKS


@dataclass(frozen=True)
class Cost:
    size: float
    block_num: float
    partition_num: int


def segments(positions: Sequence[int], cuts: frozenset[int]) -> list[list[int]]:
    """Contiguous runs of positions; a cut comes after its position."""
    out: list[list[int]] = [[]]
    for p in positions:
        out[-1].append(p)
        if p in cuts and p != positions[-1]:
            out.append([])
    return out


def _hits(load: TableLoad, layout: Layout, query: str) -> tuple[list[list[int]], list[list[int]]]:
    rows = segments(range(1, load.blocks + 1), layout.row_cuts)
    cols = segments(range(load.n_columns), layout.col_cuts)
    # without a sort key, or where nothing is known of its blocks, a query reads all blocks
    every = frozenset(range(1, load.blocks + 1))
    blocks = load.loc.get(query, {}).get(layout.sort_key, every) if layout.sort_key is not None else every
    return [s for s in rows if blocks & set(s)], [s for s in cols if load.targets[query] & set(s)]


def cost(load: TableLoad, layout: Layout) -> Cost:
    size = number = 0.0
    for q in load.targets:
        rows, cols = _hits(load, layout, q)
        touched = sum(map(len, rows)) * sum(map(len, cols))
        size += load.freq[q] * load.size_mb * touched / (load.blocks * load.n_columns)
        number += load.freq[q] * len(rows) * len(cols)
    parts = len(segments(range(1, load.blocks + 1), layout.row_cuts)) * len(segments(range(load.n_columns), layout.col_cuts))
    return Cost(size, number, parts)


def expand(load: TableLoad, layout: Layout, query: str) -> tuple[list[int], list[int]]:
    """Row blocks and columns that a query's partition holds."""
    rows, cols = _hits(load, layout, query)
    return [b for s in rows for b in s], [c for s in cols for c in s]


# DataFrame form -----------------------------------------------------------------------------------------------------


def segment_ids(positions: DataFrame, cuts: DataFrame, by: Sequence[str], pos: str) -> DataFrame:
    """(by..., pos, segment): one more than the cuts before a position. cuts has (by..., pos) after which to cut."""
    marked = positions.join(cuts.withColumn("__cut", F.lit(1)), [*by, pos], "left")
    before = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return marked.withColumn("segment", 1 + F.coalesce(F.sum("__cut").over(before), F.lit(0))).drop("__cut")


def _hit_segments(segmented: DataFrame, touched: DataFrame, pos: str) -> DataFrame:
    """(query_id, table_name, segment, pos) of all positions in segments that a query touches."""
    hit = touched.join(segmented, ["table_name", pos]).select("query_id", "table_name", "segment").distinct()
    return hit.join(segmented, ["table_name", "segment"])


def cost_frame(sizes: DataFrame, blocks: DataFrame, columns: DataFrame, row_cuts: DataFrame, col_cuts: DataFrame, loc: DataFrame, targets: DataFrame, freq: DataFrame) -> DataFrame:
    """(query_id, table_name, hit_rows, hit_cols, row_segments, col_segments, cost) by query and table.

    sizes: (table_name, size_mb); blocks: (table_name, block_id); columns: (table_name, c); loc: (query_id,
    table_name, block_id) under the chosen sort key; targets: (query_id, table_name, c); freq: (query_id, freq).
    """
    rows = _hit_segments(segment_ids(blocks, row_cuts, ["table_name"], "block_id"), loc, "block_id")
    cols = _hit_segments(segment_ids(columns, col_cuts, ["table_name"], "c"), targets, "c")
    rows = rows.groupBy("query_id", "table_name").agg(F.countDistinct("block_id").alias("hit_rows"), F.countDistinct("segment").alias("row_segments"))
    cols = cols.groupBy("query_id", "table_name").agg(F.countDistinct("c").alias("hit_cols"), F.countDistinct("segment").alias("col_segments"))
    totals = blocks.groupBy("table_name").agg(F.count("*").alias("B")).join(columns.groupBy("table_name").agg(F.count("*").alias("C")), "table_name").join(sizes, "table_name")
    out = rows.join(cols, ["query_id", "table_name"]).join(totals, "table_name").join(freq, "query_id")
    touched = F.col("hit_rows") * F.col("hit_cols") / (F.col("B") * F.col("C"))
    return out.select("query_id", "table_name", "hit_rows", "hit_cols", "row_segments", "col_segments", (F.col("freq") * F.col("size_mb") * touched).alias("cost"))


def table_cost(by_query: DataFrame, freq: DataFrame) -> DataFrame:
    """(table_name, cost, block_num)."""
    joined = by_query.join(freq, "query_id")
    return joined.groupBy("table_name").agg(F.sum("cost").alias("cost"), F.sum(F.col("freq") * F.col("row_segments") * F.col("col_segments")).alias("block_num"))


def expand_frame(blocks: DataFrame, columns: DataFrame, row_cuts: DataFrame, col_cuts: DataFrame, loc: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, table_name, row_blocks, col_block): what each query's partition of each table holds."""
    rows = _hit_segments(segment_ids(blocks, row_cuts, ["table_name"], "block_id"), loc, "block_id")
    cols = _hit_segments(segment_ids(columns, col_cuts, ["table_name"], "c"), targets, "c")
    rows = rows.groupBy("query_id", "table_name").agg(F.sort_array(F.collect_set("block_id")).alias("row_blocks"))
    cols = cols.groupBy("query_id", "table_name").agg(F.sort_array(F.collect_set("c")).alias("col_block"))
    return rows.join(cols, ["query_id", "table_name"])


def hash_cost_frame(loc: DataFrame, sizes: DataFrame, freq: DataFrame, parts: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """(query_id, table_name, cost) of hash partitioning: block i is in partition i mod parts, and a query reads the
    partitions that hold one of its blocks."""
    spark = loc.sparkSession
    every = spark.range(1, blocks + 1).select(F.col("id").cast("int").alias("block_id"), F.pmod("id", F.lit(parts)).cast("int").alias("part"))
    hit = loc.select("query_id", "table_name", F.pmod("block_id", F.lit(parts)).cast("int").alias("part")).distinct()
    read = hit.join(every, "part").groupBy("query_id", "table_name").agg(F.count("*").alias("n"))
    return read.join(sizes, "table_name").join(freq, "query_id").select("query_id", "table_name", (F.col("freq") * F.col("size_mb") * F.col("n") / blocks).alias("cost"))
