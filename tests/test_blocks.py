import datetime
import decimal
import random

import pytest

from stratum.operators import blocks


def frame(spark, n, extra=0):
    return spark.createDataFrame([(i, f"v{i % 7}") for i in range(1, n + 1)], "id long, v string")


@pytest.mark.parametrize("n,sizes", [(25, [2, 3, 2, 3, 2, 3, 2, 3, 2, 3]), (1, [0] * 9 + [1]), (3, [0, 0, 0, 1, 0, 0, 1, 0, 0, 1]), (9, [0] + [1] * 9), (10, [1] * 10), (11, [1, 1, 1, 1, 1, 1, 1, 1, 1, 2])])
def test_blocks_are_equi_depth_by_ceiling(spark, n, sizes):
    got = [0] * 10
    for r in blocks.with_block(frame(spark, n), ["id"]).collect():
        got[r.block_id - 1] += 1
    assert got == sizes


def test_nulls_come_last_and_positions_are_global(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 1), (4, 5), (5, None)], "id long, x int")
    got = {r.id: (r.rn, r.rn_of) for r in blocks.with_position(df, ["x", "id"]).collect()}
    assert got == {3: (1, 5), 1: (2, 5), 4: (3, 5), 2: (4, 5), 5: (5, 5)}
    assert blocks.with_block(df.limit(0), ["x"]).count() == 0


def brute(rows, key, n=10):
    order = sorted(range(len(rows)), key=lambda i: [(v is None, 0 if v is None else v) for v in key(rows[i])])
    return {rows[i][0]: -(-(rank + 1) * n // len(rows)) for rank, i in enumerate(order)}


@pytest.mark.parametrize("leaf,drawn", [(1 << 20, 1 << 14), (40, 64), (5, 100)])
def test_ends_are_exact_however_windows_are_narrowed(spark, monkeypatch, leaf, drawn):
    monkeypatch.setattr(blocks, "LEAF", leaf)
    monkeypatch.setattr(blocks, "DRAWN", drawn)
    rng, day = random.Random(4), datetime.datetime(2024, 3, 31)
    rows = [
        (i, rng.choice([None, 1, 1, 1, 7, rng.randrange(200)]), rng.choice([None, "ä", "z" * rng.randrange(4)]), rng.choice([None, decimal.Decimal(rng.randrange(900)) / 100]), day + datetime.timedelta(minutes=rng.randrange(300)))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "id long, x int, s string, m decimal(9,2), at timestamp")
    got = {}
    for r in blocks.all_blocks(df, ["x", "s", "m", "at", "id"], ["id"]).collect():
        got.setdefault(r.order_column, {})[r.id] = r.block_id
    for j, c in enumerate(["id", "x", "s", "m", "at"]):
        assert got[c] == brute(rows, lambda r, j=j: (r[j], r[0]))


@pytest.mark.parametrize("leaf", [1 << 20, 20])
def test_ties_across_an_end_still_give_even_blocks(spark, monkeypatch, leaf):
    monkeypatch.setattr(blocks, "LEAF", leaf)
    monkeypatch.setattr(blocks, "DRAWN", 50)
    got = blocks.with_block(frame(spark, 500), ["v"]).groupBy("block_id").count().collect()
    assert {r.block_id: r["count"] for r in got} == {b: 50 for b in range(1, 11)}
    assert blocks.cuts(frame(spark, 500), ["v"]).tied and not blocks.cuts(frame(spark, 500), ["v", "id"]).tied


def test_blocks_neither_shuffle_nor_write(spark):
    plan = blocks.with_block(frame(spark, 100), ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan" not in plan


def test_locations_of_hits(spark):
    df = frame(spark, 100)
    hits = spark.createDataFrame([(i,) for i in (1, 2, 55, 100)], "id long")
    got = {r.order_column: r.blocks for r in blocks.locations(df, hits, ["id", "v"], ["id"]).collect()}
    assert got["id"] == [1, 6, 10] and set(got) == {"id", "v"}


def test_equality_ignores_nulls_and_ranges_merge(spark):
    base = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "x")], "id long, p string, q string")
    result = spark.createDataFrame([("a", None), ("b", "x")], "p string, q string")
    assert [(r.block_id, r.hit_rows) for r in blocks.locate_by_equality(base, result, ["id"]).collect()] == [(10, 1)]
    touched = spark.createDataFrame([(b,) for b in (1, 2, 3, 5, 8, 9)], "block_id int")
    assert sorted(tuple(r) for r in blocks.merged_ranges(touched).collect()) == [(1, 3), (5, 5), (8, 9)]
