"""Row blocks: equi-depth blocks of a table under any sort key, and the blocks that a query touches.

Positions are exact and global, and no task ever sorts the whole table: rows are dealt out by ranges of the key,
written once, counted per range (a row per range), and numbered within ranges from their offsets. The block of row
number rn of N is ceil(rn * B / N), in integers; that is not ntile.

Blocks need no positions, only the rows that end them (nine for ten blocks). These are selected exactly: a draw of
fixed size proposes a narrow window around each, one scan counts what lies before and in the windows, and a window is
sorted once it is small. The draw decides how many scans it takes, not what is found. The block of a row is then an
expression over its own columns: the table is neither shuffled nor written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, sqrt

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratum.plans.store import written

BLOCKS = 10
#: Sort columns that are searched at the same time.
AT_ONCE = 4
#: Rows of a window that one task sorts, and rows drawn from a larger one to narrow it.
LEAF, DRAWN = 1 << 20, 1 << 14


def order_by(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def with_position(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """df with the 1-based position of each row in a total order (nulls last), as column `name`, and the row count
    as `<name>_of`. The order should be total; else ties are numbered arbitrarily."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order_by(order)).withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    # a row per range: the window over them is as small as the number of ranges
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias(f"{name}_of"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order_by(order)))
    numbered = ranged.withColumn("__in", inside).join(F.broadcast(offsets), "__range")
    return numbered.withColumn(name, F.col("__before") + F.col("__in")).drop("__range", "__in", "__before")


def block_of(position: Column, total: Column, blocks: int = BLOCKS) -> Column:
    return F.floor((position * blocks + total - 1) / total).cast("int")


def place(df: DataFrame, order: Sequence[str]) -> Column:
    """The place of a row in the order as one value that compares like it: nulls last, and timestamps as numbers so that
    a collected one comes back as the same instant."""
    parts = []
    for i, c in enumerate(order):
        value = F.unix_micros(F.col(c)) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c)
        parts += [F.col(c).isNull().alias(f"n{i}"), value.alias(f"v{i}")]
    return F.struct(*parts)


def _constant(row: Row, kind: T.StructType) -> Column:
    return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(kind.fields, row, strict=True)))


@dataclass(frozen=True)
class _Window:
    """The `rows` rows above place `low` and up to place `high` (None: no limit); `below` rows come before them, and the
    rows at positions `at` are among them."""

    low: Row | None
    high: Row | None
    below: int
    rows: int
    at: tuple[int, ...]

    def holds(self, kind: T.StructType) -> Column:
        row, inside = F.col("__row"), F.lit(True)
        if self.low is not None:
            inside = inside & (row > _constant(self.low, kind))
        return inside if self.high is None else inside & (row <= _constant(self.high, kind))


@dataclass(frozen=True)
class Cuts:
    """The places after which blocks end. `first` blocks end before any row; `tied` says that rows of one place lie on
    both sides of an end, so that places alone do not tell their blocks."""

    kind: T.StructType
    first: int
    ends: tuple[Row, ...]
    tied: bool

    def block(self, row: Column) -> Column:
        after = [(row > _constant(end, self.kind)).cast("int") for end in self.ends]
        return reduce(Column.__add__, after, F.lit(self.first + 1)).cast("int")


def _tagged(rows: DataFrame, windows: Sequence[_Window], kind: T.StructType) -> DataFrame:
    """(w, __row): the rows in each window; a row may lie in two that overlap."""
    mine = F.array_compact(F.array(*(F.when(w.holds(kind), i) for i, w in enumerate(windows))))
    return rows.select(F.explode(mine).alias("w"), "__row")


def _narrowed(rows: DataFrame, kind: T.StructType, windows: Sequence[_Window], seed: int) -> tuple[list[_Window], dict[int, tuple[Row, bool]]]:
    """A smaller window for each position in these, from one scan that draws and one that counts; places that the count
    settles already."""
    share = F.element_at(F.array(*(F.lit(min(1.0, DRAWN / w.rows)) for w in windows)), F.col("w") + 1)
    drawn_of = _tagged(rows, windows, kind).where(F.rand(seed) < share).groupBy("w").agg(F.sort_array(F.collect_list("__row")).alias("drawn"))
    near: dict[tuple[int, int], list[Row]] = {}
    for i, drawn in drawn_of.collect():
        for p in windows[i].at:
            expected = (p - windows[i].below) * len(drawn) / windows[i].rows
            margin = 4 * sqrt(max(0.0, expected * (1 - expected / len(drawn)))) + 4
            around = [drawn[j] for j in (floor(expected - margin), ceil(expected + margin)) if 0 <= j < len(drawn)]
            near[i, p] = around if len(around) == 2 else [*around, drawn[max(0, ceil(expected) - 1)]]
    splits = [_constant(s, kind) for s in dict.fromkeys(s for some in near.values() for s in some)]
    if not splits:
        return list(windows), {}
    row, constants = F.col("__row"), F.sort_array(F.array(*splits))
    # how many splits lie before a row, and whether it is the next one: at most two rows a split come back
    less = reduce(Column.__add__, [(row > s).cast("int") for s in splits])
    told = rows.select("__row", less.alias("less")).select("less", F.coalesce(row == F.get(constants, F.col("less")), F.lit(False)).alias("same"))
    counted = told.groupBy("less", "same").count().collect()
    ordered = rows.sparkSession.range(1).select(F.sort_array(constants)).first()[0]
    upto = {s: sum(n for less, _, n in counted if less <= j) for j, s in enumerate(ordered)}
    before = {s: upto[s] - sum(n for less, same, n in counted if less == j and same) for j, s in enumerate(ordered)}
    left, found = [], {}
    for i, w in enumerate(windows):
        for p in w.at:
            some = near.get((i, p), [])
            exact = [s for s in some if before[s] < p <= upto[s]]
            if exact:
                found[p] = (exact[0], upto[exact[0]] > p)
                continue
            # wherever the draw was unlucky, the window lies on the other side of its split
            low = max((s for s in some if upto[s] < p), key=upto.get, default=None)
            high = min((s for s in some if before[s] >= p), key=upto.get, default=None)
            below, last = w.below if low is None else upto[low], w.below + w.rows if high is None else upto[high]
            left.append(_Window(w.low if low is None else low, w.high if high is None else high, below, last - below, (p,)))
    return left, found


def cuts(df: DataFrame, order: Sequence[str], blocks: int = BLOCKS) -> Cuts:
    """The ends of equi-depth blocks under an order. df is read several times, its sort columns alone."""
    rows = df.select(place(df, order).alias("__row"))
    kind, total = rows.schema["__row"].dataType, rows.count()
    wanted = [b * total // blocks for b in range(1, blocks)]
    at = tuple(p for p in dict.fromkeys(wanted) if p)
    found: dict[int, tuple[Row, bool]] = {}
    windows, seed = ([_Window(None, None, 0, total, at)] if at else []), 0
    while large := [w for w in windows if w.rows > LEAF]:
        smaller, settled = _narrowed(rows, kind, large, seed)
        windows, seed = [w for w in windows if w.rows <= LEAF] + smaller, seed + 1
        found |= settled
    if windows:
        numbered = _tagged(rows, windows, kind).withColumn("rn", F.row_number().over(Window.partitionBy("w").orderBy("__row")))
        picks = [(F.col("w") == i) & F.col("rn").isin([n for p in w.at for n in (p - w.below, p - w.below + 1)]) for i, w in enumerate(windows)]
        got = {(r.w, r.rn): r["__row"] for r in numbered.where(reduce(Column.__or__, picks)).collect()}
        for i, w in enumerate(windows):
            for p in w.at:
                end, following = got[i, p - w.below], got.get((i, p - w.below + 1))
                # the last row of a window has its equals inside too
                found[p] = (end, end == following)
    ends = [found[p] for p in wanted if p]
    return Cuts(kind, wanted.count(0), tuple(end for end, _ in ends), any(tied for _, tied in ends))


def with_block(df: DataFrame, order: Sequence[str], blocks: int = BLOCKS, name: str = "block_id") -> DataFrame:
    """df with the block of each row; rows that the order leaves tied across the end of a block are numbered to tell."""
    found = cuts(df, order, blocks)
    if not found.tied:
        return df.withColumn(name, found.block(place(df, order)))
    numbered = with_position(df, order, "__rn")
    exact = F.expr(f"CAST((__rn * {blocks} + __rn_of - 1) div __rn_of AS INT)")
    return numbered.withColumn(name, exact).drop("__rn", "__rn_of")


def cuts_by_column(df: DataFrame, candidates: Sequence[str], key: Sequence[str], blocks: int = BLOCKS) -> dict[str, Cuts]:
    """Cuts under every candidate sort column, ties by key; the searches of a few columns share the cluster at a time."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = pool.map(lambda c: cuts(df, _by(c, key), blocks), candidates)
        return dict(zip(candidates, found, strict=True))


def _by(column: str, key: Sequence[str]) -> list[str]:
    return [column, *(k for k in key if k != column)]


def placed(rows: DataFrame, found: Mapping[str, Cuts], key: Sequence[str], *keep: str) -> DataFrame:
    """(key..., keep..., order_column, block_id): some rows of the table under every column of the cuts. Rows that are
    equal in the column and the whole key share a block."""
    each = [F.struct(F.lit(c).alias("order_column"), cut.block(place(rows, _by(c, key))).alias("block_id")) for c, cut in found.items()]
    return rows.select(*key, *keep, F.inline(F.array(*each)))


def all_blocks(df: DataFrame, candidates: Sequence[str], key: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """(key..., order_column, block_id): the block of every row under every candidate sort column, ties by key."""
    return placed(df, cuts_by_column(df, candidates, key, blocks), key)


def locations(df: DataFrame, hits: DataFrame, candidates: Sequence[str], key: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """(order_column, blocks): which blocks hold rows whose key is among the hits, for every candidate sort column.

    The query runs once (hits are its keys); all columns share the one semi-join, and only rows that it keeps are placed.
    """
    touched = df.select(*dict.fromkeys([*key, *candidates])).join(hits.select(*key), list(key), "left_semi")
    blocked = placed(touched, cuts_by_column(df, candidates, key, blocks), key)
    return blocked.groupBy("order_column").agg(F.sort_array(F.collect_set("block_id")).alias("blocks"))


def touched_blocks(df: DataFrame, hits: DataFrame, order: Sequence[str], key: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """(block_id, hit_rows) under one order."""
    return with_block(df, order, blocks).join(hits.select(*key), list(key), "left_semi").groupBy("block_id").agg(F.count("*").alias("hit_rows"))


def locations_many(tables: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]], hits: Mapping[str, Mapping[str, DataFrame]], blocks: int = BLOCKS) -> DataFrame:
    """(query_id, table_name, order_column, blocks) for several queries: tables maps a name to (rows, candidate columns,
    key) and hits maps query -> table -> keys. Keys of several instances of a table are united before they get here."""
    parts = []
    for name, (df, candidates, key) in tables.items():
        keyed = [h[name].select(*key).distinct().withColumn("query_id", F.lit(q)) for q, h in hits.items() if name in h]
        if not keyed:
            continue
        touched = df.select(*dict.fromkeys([*key, *candidates])).join(reduce(DataFrame.unionByName, keyed), list(key))
        blocked = placed(touched, cuts_by_column(df, candidates, key, blocks), key, "query_id")
        parts.append(blocked.groupBy("query_id", "order_column").agg(F.sort_array(F.collect_set("block_id")).alias("blocks")).withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts).select("query_id", "table_name", "order_column", "blocks")


def locate_by_equality(base: DataFrame, result: DataFrame, order: Sequence[str], blocks: int = BLOCKS) -> DataFrame:
    """(block_id, hit_rows) of base rows that equal a result row on all columns that both have; null equals nothing."""
    shared = [c for c in base.columns if c in result.columns]
    return with_block(base, order, blocks).join(result.select(*shared).distinct(), shared, "left_semi").groupBy("block_id").agg(F.count("*").alias("hit_rows"))


def merged_ranges(touched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., first_block, last_block): runs of neighbouring blocks as ranges."""
    run = F.col("block_id") - F.row_number().over(Window.partitionBy(*by).orderBy("block_id"))
    return touched.select(*by, "block_id").distinct().withColumn("__run", run).groupBy(*by, "__run").agg(F.min("block_id").alias("first_block"), F.max("block_id").alias("last_block")).drop("__run")
