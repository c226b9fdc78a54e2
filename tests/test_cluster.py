import numpy as np
import pytest

from stratum.operators import cluster as cl


def slow_dtw(x, y):
    a, b = cl.unit(np.array(x, float)), cl.unit(np.array(y, float))
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1]


def test_dtw_is_exact():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (1, 5), (6, 6), (7, 3), (20, 31)):
        x, y = rng.random(n), rng.random(m)
        assert cl.dtw(x, y) == pytest.approx(slow_dtw(x, y))
    assert cl.dtw([1, 2, 3], [2, 4, 6]) == pytest.approx(0) and cl.dtw([0, 0], [0, 0]) == 0
    assert cl.dtw([0, 1, 0, 0], [0, 0, 1, 0]) == pytest.approx(0)


def frame(spark, features):
    return spark.createDataFrame([(k, [float(v) for v in x]) for k, x in features.items()], "template_id long, feature array<double>")


def test_chains_singletons_and_pairs(spark):
    t = np.linspace(0, 6, 40)
    rise = lambda s: np.maximum(0, t - s)
    near = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.1), (5, 6, 0.1)], "a long, b long, distance double")
    templates = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6)], "template_id long")
    got = {r.template_id: r.cluster for r in cl.dbscan(templates, near).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    edge = {r.template_id: r.cluster for r in cl.dbscan(templates, near, min_points=2).collect()}
    assert edge[1] == edge[2] == edge[3] and edge[5] == 5 and edge[6] == 6
    features = {1: rise(1), 2: 3 * rise(1), 3: np.ones(40), 4: [1.0]}
    out = {r.template_id: r.cluster for r in cl.cluster(frame(spark, features), 0.05, bound=2).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: -1}


def test_neighbours_find_every_pair_once(spark):
    rng = np.random.default_rng(1)
    features = {i: rng.random(12) for i in range(17)}
    want = {(a, b) for a in features for b in features if a < b and cl.dtw(features[a], features[b]) < 0.5}
    got = [(r.a, r.b) for r in cl.neighbours(frame(spark, features), 0.5, blocks=3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_bounded_tables_give_the_distances(spark):
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 4), (5, 5), (9, 6)):
        x, y = rng.random((n, 40)), rng.random((m, 40))
        x, y = x / np.sqrt((x * x).sum(0)), y / np.sqrt((y * y).sum(0))
        want = np.array([slow_dtw(x[:, k], y[:, k]) for k in range(40)])
        for rho in (np.inf, float(np.median(want))):
            got = cl.dtw_below(x, y, rho)
            assert np.allclose(got[want < rho], want[want < rho]) and (got[want >= rho] >= rho).all()
    features = {i: rng.random(int(rng.integers(0, 5))) for i in range(40)} | {90: np.zeros(3), 91: np.zeros(3)}
    want = {(a, b) for a in features for b in features if a < b and cl.dtw(features[a], features[b]) < 0.3}
    for blocks in (1, 4):
        assert {(r.a, r.b) for r in cl.neighbours(frame(spark, features), 0.3, blocks=blocks).collect()} == want
    assert cl.neighbours(frame(spark, {1: [1.0]}).limit(0), 0.3).count() == 0


def repeated_curves():
    rng = np.random.default_rng(6)
    curves = [*(rng.random(6) for _ in range(5)), np.zeros(6), 2.0 * np.ones(6)]
    return {i: curves[i % 7] for i in range(63)} | {70: [1.0], 80: [np.nan, 1.0], 81: [np.nan, 1.0], 90: rng.random(6), 91: 9 * rng.random(6)}


def test_equal_curves_cluster_as_one(spark, monkeypatch):
    features = repeated_curves()
    seen, near_curves = [], cl._near_curves
    monkeypatch.setattr(cl, "_near_curves", lambda rows, *more: seen.append(rows.count()) or near_curves(rows, *more))
    templates = spark.createDataFrame([(i,) for i in features], "template_id long")
    for rho, min_points in ((0.4, 1), (0.3, 8), (0.5, 12), (0.4, 20), (0.0, 1)):
        pairs = [(a, b, float(d)) for a in features for b in features if a < b and (d := cl.dtw(features[a], features[b])) < rho]
        near = spark.createDataFrame(pairs, "a long, b long, distance double")
        want = {(r.template_id, r.cluster) for r in cl.dbscan(templates, near, min_points).collect()}
        assert {(r.template_id, r.cluster) for r in cl.cluster(frame(spark, features), rho, min_points=min_points).collect()} == want
    # seven curves of nine templates each, and five templates beside them
    assert seen == [12] * 4


def test_components_need_no_pairs_inside_them(spark, monkeypatch):
    rng = np.random.default_rng(8)
    shapes = [rng.random(8) for _ in range(6)]
    # many near the first shape, few near others, some near none
    features = {i: shapes[0 if i % 3 else i % 6] + 0.02 * rng.random(8) for i in range(60)} | {100 + i: 9.0 ** rng.permutation(8) for i in range(8)}
    want = {(r.template_id, r.cluster) for r in cl.cluster(frame(spark, features), 0.15).collect()}
    assert 4 < len({c for _, c in want}) < 20
    for large in (6, 12):
        monkeypatch.setattr(cl, "_FEW_BLOCKS", 2)
        monkeypatch.setattr(cl, "_LARGE_BLOCK", large)
        assert {(r.template_id, r.cluster) for r in cl.cluster(frame(spark, features), 0.15).collect()} == want
        links = cl._component_links(cl.equal_curves(frame(spark, features))[0], 0.15)
        assert links.count() < cl.neighbours(frame(spark, features), 0.15).count() / 2


def test_equal_curves_are_compared_once(spark, monkeypatch):
    features = repeated_curves()
    want = {(a, b): d for a in features for b in features if a < b and (d := cl.dtw(features[a], features[b])) < 0.5}
    seen, near_curves = [], cl._near_curves
    monkeypatch.setattr(cl, "_near_curves", lambda rows, *more: seen.append(rows.count()) or near_curves(rows, *more))
    for members in (512, 4):
        monkeypatch.setattr(cl, "_MEMBERS", members)
        got = [((r.a, r.b), r.distance) for r in cl.neighbours(frame(spark, features), 0.5).collect()]
        assert len(got) == len(want) and dict(got) == pytest.approx(want)
    assert seen == [12] * 2
    assert cl.neighbours(frame(spark, features), 0.0).count() == 0


def test_long_rows_are_computed_as_a_whole(monkeypatch):
    rng = np.random.default_rng(3)
    series, ids = [cl.unit(rng.random(7)) for _ in range(40)], rng.permutation(40)
    labels, calls, below = rng.integers(0, 5, 40), [], cl.dtw_below
    monkeypatch.setattr(cl, "dtw_below", lambda a, b, rho: calls.append(a.strides[-1]) or below(a, b, rho))
    for blocks in (np.zeros(40, int), np.repeat([0, 1], 20)):
        got = []
        for tables in (2048, 8):
            monkeypatch.setattr(cl, "_TABLES", tables)
            got.append({(min(a, b), max(a, b)): d for a, b, d in zip(*cl._near_pairs(ids, series, blocks, 0.5, labels), strict=True)})
        assert got[0] == got[1] and got[0]
    assert 0 in calls


def test_centers_are_aligned_at_the_end(spark):
    series = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 3.0), (2, 1, 10.0), (2, 2, 20.0), (3, 0, 5.0)], "template_id long, t long, rate double")
    assigned = spark.createDataFrame([(1, 7), (2, 7), (3, -1)], "template_id long, cluster long")
    got = {(r.cluster, r.back): r.total for r in cl.centers(series, assigned).collect()}
    assert got == {(7, 0): 23, (7, 1): 12, (7, 2): 1}
    newest = spark.createDataFrame([(1, 4.0), (2, 30.0)], "template_id long, rate double")
    got = {(r.cluster, r.back): r.total for r in cl.add_newest(cl.centers(series, assigned), newest, assigned).collect()}
    assert got[7, 0] == 34 and got[7, 1] == 23 and got[7, 3] == 1


def test_rounds_of_adjustment():
    up, down = np.arange(1.0, 21), np.arange(20.0, 0, -1)
    state = cl.ClusterState(rho=0.2, bound=5)
    state.adjust({1: up, 2: 2 * up, 3: down, 4: np.ones(3)})
    assert state.assigned[1] == state.assigned[2] != state.assigned[3] and state.assigned[4] == -1
    assert np.allclose(state.centers[state.assigned[1]], 3 * up)
    state.trace({1: 21.0, 2: 42.0, 3: 0.0})
    assert state.centers[state.assigned[1]][-1] == 63
    # template 2 turns around: it leaves and joins the falling cluster
    state.adjust({1: np.append(up, 21), 2: np.append(down, 0) * 2, 3: np.append(down, 0), 4: np.append(up, 21)})
    assert state.assigned[2] == state.assigned[3] and state.assigned[4] != -1
    assert all(home in state.centers for home in state.assigned.values())


def test_close_centers_are_merged():
    state = cl.ClusterState(rho=0.1)
    up = np.arange(1.0, 11)
    state.assigned, state.centers = {1: 0, 2: 1}, {0: up.copy(), 1: 5 * up}
    state._merge()
    assert state.assigned == {1: 0, 2: 0} and np.allclose(state.centers[0], 6 * up)
