import math

import numpy as np
import pytest

from stratum.operators import forecast as fc


@pytest.mark.parametrize("name", fc.MODELS)
def test_models_follow_a_clear_signal(name):
    t = np.arange(1200)
    z = np.sin(2 * np.pi * t / 48)
    settings = {"holt_winters": {"season": 48}, "lstm": {"epochs": 12}}.get(name, {})
    ahead = fc.MODELS[name](z[:900], 0, **settings)(z[852:900], 12)
    assert ahead.shape == (12,) and np.sqrt(np.mean((ahead - z[900:912]) ** 2)) < 0.35


@pytest.mark.parametrize("name", fc.MODELS)
def test_models_stand_short_and_constant_series(name):
    for z in (np.zeros(100), np.array([1.0, 2.0])):
        out = fc.MODELS[name](z, 0)(z, 5)
        assert out.shape == (5,) and np.isfinite(out).all()


def rows(spark, data):
    return spark.createDataFrame([(k, t, float(v)) for k, x in data.items() for t, v in enumerate(x)], "template_id long, t long, rate double")


def test_rolling_origins_and_scores(spark):
    t = np.arange(400)
    series = rows(spark, {1: 5 + np.sin(t / 5), 2: np.full(400, 3.0)})
    out = fc.rolling_forecast(series, {"linear": 0.5, "dlinear": 0.5}, 10, look_back=48, tail=40)
    got = out.collect()
    assert sorted({r.origin for r in got}) == list(range(300, 360, 10)) and len(got) == 2 * 60
    assert all(abs(r.rate - 3) < 1e-9 for r in got if r.template_id == 2)
    scores = fc.score(series, out).orderBy("origin").collect()
    assert all(s.rmse == pytest.approx(math.sqrt(s.mse)) for s in scores) and scores[0].mae < 0.2


def test_score_takes_the_root_of_the_mean(spark):
    actual = rows(spark, {1: [1, 2, 3], 2: [0, 0, 0]})
    predicted = spark.createDataFrame([(1, 0, 0, 2.0), (1, 0, 1, 2.0), (1, 0, 2, 5.0), (2, 0, 0, 3.0), (2, 0, 1, 0.0), (2, 0, 2, 0.0)], "template_id long, origin long, t long, rate double")
    s = fc.score(actual, predicted).first()
    assert (s.mae, s.mse) == (pytest.approx(1.0), pytest.approx((5 / 3 + 3) / 2)) and s.rmse == pytest.approx(math.sqrt(s.mse))
    assert fc.mean_score(fc.score(actual, predicted)).first().mae == pytest.approx(1.0)


def test_normalising_and_back(spark):
    series = rows(spark, {1: [1, 2, 3, 4], 2: [7, 7, 7, 7]})
    got = {(r.template_id, r.t): (r.z, r.mean, r["std"]) for r in fc.normalized(series).collect()}
    assert got[2, 0][0] == 0 and got[1, 0][0] == pytest.approx(-1.5 / np.std([1, 2, 3, 4], ddof=1))
    z = fc.normalized(series).select("template_id", "t", "z")
    stats = fc.normalized(series).select("template_id", "mean", "std").distinct()
    assert {(r.template_id, r.t): round(r.rate, 9) for r in fc.denormalized(z, stats).collect()}[1, 3] == 4


def test_top_and_sweep(spark):
    series = rows(spark, {k: [k] * 4 for k in range(1, 15)})
    got = {r.template: r.mean_rate for r in fc.top_and_others(series).collect()}
    assert got["others"] == 1 + 2 + 3 + 4 and len(got) == 11
    sweep = fc.horizon_sweep(rows(spark, {1: np.arange(200.0)}), {"linear": 1.0}, (3, 6), look_back=20, tail=20)
    assert sorted(r.horizon for r in sweep.collect()) == [3, 6]
