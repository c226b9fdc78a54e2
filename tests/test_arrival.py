import math

from pyspark.sql import functions as F

from stratum.functions import arrival


def series(spark, column, n):
    return [r.rate for r in arrival.steps(spark, n).select("t", column.alias("rate")).orderBy("t").collect()]


def bell(x, c, w, s):
    return s / (math.sqrt(2 * math.pi) * w / 2) * math.exp(-((x - c) ** 2) / (2 * (w / 2) ** 2))


def test_cycle_closed_form(spark):
    got = series(spark, arrival.cycle(F.col("t"), {200: [(40, 15, 100), (120, 30, 80)], 500: [(300, 100, 200)]}, 30), 300)
    for t in (0, 40, 200, 240):
        want = 30 + bell(t % 200, 40, 15, 100) + bell(t % 200, 120, 30, 80) + bell(t % 500, 300, 100, 200)
        assert abs(got[t] - want) < 1e-9


def test_stability_is_clipped_and_seeded(spark):
    assert series(spark, arrival.stability(-5), 3) == [0, 0, 0]
    one, two = (series(spark, arrival.stability(20, "gaussian", (0, 1, 4), seed=3), 500) for _ in range(2))
    assert one == two and min(one) >= 0 and all(x == int(x) for x in one) and len(set(one)) > 5
    assert set(series(spark, arrival.stability(10, "random", (0, 3), seed=1), 200)) == {10, 11, 12}


def test_spikes_decay(spark):
    base = arrival.steps(spark, 20).select(F.lit(1).alias("template_id"), "t", F.lit(1.0).alias("rate"))
    spikes = spark.createDataFrame([(1, 5, 10.0, 3), (1, 19, 4.0, 5)], "template_id int, start long, height double, length int")
    got = [r.rate for r in arrival.add_spikes(base, spikes, "random").orderBy("t").collect()]
    assert len(got) == 20 and abs(got[6] - (1 + 10 * math.exp(-1 / 3))) < 1e-9 and got[8] == 1 and got[19] == 5
    got = [r.rate for r in arrival.add_spikes(base, spikes, "cycle").orderBy("t").collect()]
    assert abs(got[7] - (1 + 10 * math.cos(math.pi / 6 * 2))) < 1e-9


def test_generated_series_repeat_and_are_never_negative(spark):
    patterns = arrival.sample_patterns(12, 600, seed=4)
    assert {p.kind for p in patterns} <= set(arrival.KINDS) and patterns == arrival.sample_patterns(12, 600, seed=4)
    rows = arrival.arrival_rates(spark, patterns, 600, seed=4)
    stats = rows.agg(F.count("*").alias("n"), F.min("rate").alias("low"), F.countDistinct("template_id").alias("k")).first()
    assert stats.n == 7200 and stats.low >= 0 and stats.k == 12
    again = arrival.arrival_rates(spark, patterns, 600, seed=4).agg(F.sum("rate")).first()[0]
    assert abs(again - rows.agg(F.sum("rate")).first()[0]) < 1e-6
    table = arrival.wide(rows, [p.template_id for p in patterns])
    assert table.count() == 600 and len(table.columns) == 13
