"""Clusters of query templates by the shape of their arrival curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.plans.store import written


def unit(x: np.ndarray) -> np.ndarray:
    """x at Euclidean length 1; an all-zero series stays as it is."""
    x = np.asarray(x, float)
    n = np.sqrt((x * x).sum())
    return x / n if n else x


def dtw(x: Sequence[float], y: Sequence[float]) -> float:
    """Exact dynamic-time-warping distance of the unit-length series, absolute differences along the path.

    The table is filled by anti-diagonals, each a vector operation, and only three are held.
    """
    a, b = unit(np.asarray(x, float)), unit(np.asarray(y, float))
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0 if n == m else float("inf")
    inf = np.inf
    before = last = None
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        i = np.arange(lo, hi)
        here = np.full(n + 1, inf)
        gap = np.abs(a[i] - b[d - i])
        if d == 0:
            here[i + 1] = gap
        else:
            # cell (i, j) is kept at i + 1: up and left lie on the last diagonal, the corner on the one before
            step = np.minimum(last[i], last[i + 1])
            if before is not None:
                step = np.minimum(step, before[i])
            here[i + 1] = gap + step
        before, last = last, here
    return float(last[n])


def features(series: DataFrame) -> DataFrame:
    """(template_id, feature): the rates in order of t."""
    rows = F.sort_array(F.collect_list(F.struct("t", "rate")))
    return series.groupBy("template_id").agg(F.transform(rows, lambda r: r["rate"]).alias("feature"))


def dtw_below(a: np.ndarray, b: np.ndarray, rho: float) -> np.ndarray:
    """DTW distances of the pairs (a[:, k], b[:, k]) of unit-length series, one pair a column, in the series' own number
    type; infinite where they are known to reach rho: pairs are given up as soon as two diagonals of their tables, one
    of which every path crosses, have reached it.

    Tables are filled by anti-diagonals, of which three are held; b stands in reverse, so that each is a plain slice.
    """
    n, m, kind = len(a), len(b), np.result_type(a, b)
    out, live = np.full(a.shape[1], np.inf, kind), np.arange(a.shape[1])
    b = np.ascontiguousarray(b[::-1])
    before, last, here = (np.full((n + 1, a.shape[1]), np.inf, kind) for _ in range(3))
    gaps = np.empty((n, a.shape[1]), kind)
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n, d + 1)
        gap, cells = gaps[: hi - lo], here[lo + 1 : hi + 1]
        np.abs(np.subtract(a[lo:hi], b[m - 1 - d + lo : m - 1 - d + hi], out=gap), out=gap)
        if d == 0:
            cells[:] = gap
        else:
            # cell (i, j) is kept at i + 1: up and left lie on the last diagonal, the corner on the one before
            np.minimum(last[lo:hi], last[lo + 1 : hi + 1], out=cells)
            np.add(np.minimum(cells, before[lo:hi], out=cells), gap, out=cells)
            here[: lo + 1] = here[hi + 1 : hi + 2] = np.inf
        before, last, here = last, here, before
        if d % 8 == 7 and 3 * d < 2 * (n + m):
            on = np.minimum(last.min(0), before.min(0)) < rho
            if 2 * np.count_nonzero(on) < len(live):
                live, a, b, before, last = live[on], a[:, on], b[:, on], before[:, on], last[:, on]
                here, gaps = np.full_like(last, np.inf), np.empty((n, len(live)), kind)
                if not len(live):
                    return out
    out[live] = last[n]
    return out


#: Templates in a block at least, if they fill so many blocks, and at most.
BLOCK = 128
_FEW_BLOCKS = 16
_LARGE_BLOCK = 2048
#: Pairs whose bounds are held at once, and whose tables are.
_BOUNDED = 1 << 18
_TABLES = 2048
#: Members of a class of equal curves that are paired at once with those of another.
_MEMBERS = 512


def _near_pairs(ids: np.ndarray, series: list[np.ndarray], blocks: np.ndarray, rho: float, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and distance of the pairs within rho between two blocks, or inside the only one; with labels, of those
    whose labels differ."""
    sizes, found = np.array([len(x) for x in series]), [(ids[:0], ids[:0], np.zeros(0))]
    left, right = (blocks == blocks.min()), (blocks == blocks.max())
    one = blocks.min() == blocks.max()
    for n in np.unique(sizes):
        for m in np.unique(sizes):
            x, y = np.flatnonzero(left & (sizes == n)), np.flatnonzero(right & (sizes == m))
            if not len(x) or not len(y) or (n != m and not (n and m)):
                continue
            a, b = (np.stack([series[i] for i in held], 1) for held in (x, y))
            a32, b32 = a.astype(np.float32), b.astype(np.float32)
            # tables in single precision choose the pairs that are computed: a path has at most n + m steps, each of
            # them rounded by a few parts in ten million
            roughly = rho + (n + m) * 1e-6 * (1 + abs(rho))
            strip = max(1, _BOUNDED // len(y))
            for top in range(0, len(x), strip):
                some = slice(top, min(top + strip, len(x)))
                # every path holds both corners of the table, so their cells are a lower bound
                least = np.zeros((some.stop - top, len(y)))
                if n and m:
                    least += np.abs(a[0, some][:, None] - b[0][None, :])
                if n > 1 or m > 1:
                    least += np.abs(a[-1, some][:, None] - b[-1][None, :])
                close = least < rho
                if one:
                    close &= ids[x[some]][:, None] < ids[y][None, :]
                if labels is not None:
                    close &= labels[x[some]][:, None] != labels[y][None, :]
                chosen = []
                if n and m and len(y) >= _TABLES // 2:
                    # where most of a long row is close, it is computed as a whole, without picking columns
                    for k in np.flatnonzero(2 * close.sum(1) >= len(y)).tolist():
                        whole = np.broadcast_to(a32[:, top + k, None], b32.shape)
                        q = np.flatnonzero((dtw_below(whole, b32, roughly) < roughly) & close[k])
                        chosen.append((np.full(len(q), k), q))
                        close[k] = False
                i, j = np.nonzero(close)
                for at in range(0, len(i), _TABLES):
                    p, q = i[at : at + _TABLES], j[at : at + _TABLES]
                    on = dtw_below(a32[:, top + p], b32[:, q], roughly) < roughly if n and m else np.full(len(p), True)
                    chosen.append((p[on], q[on]))
                p, q = (np.concatenate(part) for part in zip((i[:0], j[:0]), *chosen, strict=True))
                for at in range(0, len(p), _TABLES):
                    u, v = p[at : at + _TABLES] + top, q[at : at + _TABLES]
                    d = dtw_below(a[:, u], b[:, v], rho) if n and m else np.zeros(len(u))
                    on = d < rho
                    found.append((ids[x[u[on]]], ids[y[v[on]]], d[on]))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def equal_curves(feature_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(template_id, feature, n): one template, the least, of each class of n with the same feature; and (template_id,
    rep), which class each template is in. Their distance is 0, and they are as far as each other from any other
    curve. A feature with a null, a NaN or an infinity is not near itself: its template makes a class of its own."""
    rows = feature_rows.where("feature IS NOT NULL").select(F.col("template_id").cast("long").alias("template_id"), "feature")
    plain = F.forall("feature", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = written(rows.withColumn("alone", F.when(plain, 0).otherwise(F.col("template_id"))), "features")
    reps = written(rows.groupBy("feature", "alone").agg(F.min("template_id").alias("rep"), F.count("*").alias("n")), "curves")
    members = written(rows.join(reps, ["feature", "alone"]).select("template_id", "rep"), "curve-members")
    return reps.select(F.col("rep").alias("template_id"), "feature", "n"), members


def _blocks(rows: int) -> int:
    """Blocks of BLOCK rows up to _FEW_BLOCKS, then of as many rows as _LARGE_BLOCK."""
    return max(1, min(-(-rows // BLOCK), _FEW_BLOCKS), -(-rows // _LARGE_BLOCK))


def _near_curves(rows: DataFrame, rho: float, blocks: int | None = None, units_where: str = "true") -> DataFrame:
    """(a, b, distance) of all pairs of rows a < b with distance below rho, in blocks: a row goes to the units (lo, hi)
    of its block with every block, and each unit, once dealt out, bounds its pairs from below, computes those that may
    be near and returns those that are. No task holds more than two blocks, and no pair is a row before it is near.
    Rows with a label are compared with those of other labels only; units_where chooses units."""
    labelled = "label" in rows.columns
    rows = rows.select("template_id", "feature", *(["label"] if labelled else []))
    if blocks is None:
        blocks = _blocks(rows.count())
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("template_id"), F.lit(blocks)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    units = rows.withColumn("with", other).withColumn("lo", F.least("blk", "with")).withColumn("hi", F.greatest("blk", "with")).where(units_where)

    def near(held: pd.DataFrame) -> pd.DataFrame:
        own = held["blk"].to_numpy()
        labels = held["label"].to_numpy() if labelled else None
        if (held["lo"].iloc[0] != held["hi"].iloc[0] and own.min() == own.max()) or (labelled and labels.min() == labels.max()):
            return pd.DataFrame({"a": [], "b": [], "distance": []})
        got = _near_pairs(held["template_id"].to_numpy(), [unit(x) for x in held["feature"]], own, rho, labels)
        return pd.DataFrame(dict(zip(("a", "b", "distance"), got, strict=True)))

    # units are few and cheap to send but dear to compute, so they are dealt out by number, not by size
    units = units.repartition(min(blocks * (blocks + 1) // 2, 4096), "lo", "hi")
    found = units.groupBy("lo", "hi").applyInPandas(near, "a long, b long, distance double")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def _component_links(curves: DataFrame, rho: float) -> DataFrame:
    """(a, b): links with the connected components of all pairs within rho, but not all of those pairs. Where there are
    many blocks, those within a block and its next one come first; of all others, only pairs that these have not
    connected are computed. What is connected stays so by a link of each to the least of its component."""
    blocks = _blocks(curves.count())
    if blocks <= _FEW_BLOCKS:
        return _near_curves(curves, rho, blocks).select("a", "b")
    joined = dbscan(curves, _near_curves(curves, rho, blocks, "hi <= lo + 1"))
    joined = written(joined.select("template_id", F.col("cluster").alias("label")), "curve-labels")
    stars = joined.where("label <> template_id").select(F.col("label").alias("a"), F.col("template_id").alias("b"))
    rest = _near_curves(curves.join(joined, "template_id"), rho, blocks, "hi > lo + 1")
    return stars.unionByName(rest.select("a", "b"))


def neighbours(feature_rows: DataFrame, rho: float, blocks: int | None = None) -> DataFrame:
    """(a, b, distance) of all template pairs a < b with distance below rho.

    A stated set of templates against itself: one of each class of equal curves is compared, in blocks (their number
    may be given), and what is found holds for all members of both classes, who become pairs last.
    """
    curves, members = equal_curves(feature_rows)
    found = _near_curves(curves, rho, blocks)
    if curves.count() == members.count():
        return found
    if rho > 0:
        found = found.unionByName(curves.where("n > 1").select(F.col("template_id").alias("a"), F.col("template_id").alias("b"), F.lit(0.0).alias("distance")))
    parts = members.join(curves.select(F.col("template_id").alias("rep"), "n"), "rep")
    parts = parts.withColumn("part", F.pmod(F.xxhash64("template_id"), F.ceil(F.col("n") / _MEMBERS)))
    parts = parts.groupBy("rep", "part").agg(F.collect_list("template_id").alias("ids"))
    left, right = (parts.select(F.col("rep").alias(k), F.col("part").alias(f"{k}_part"), F.col("ids").alias(f"{k}_ids")) for k in "ab")
    both = found.join(left, "a").join(right, "b").where("a <> b OR a_part <= b_part")
    most = curves.agg(F.max("n")).first()[0]
    if most > _MEMBERS:
        # a large class has many parts: their pairs are dealt out before they become rows
        both = both.repartition("a", "a_part", "b", "b_part")
    both = both.withColumn("x", F.explode("a_ids")).select("a", "a_part", "b", "b_part", "distance", "x", F.explode("b_ids").alias("y"))
    both = both.where("x < y OR (x > y AND (a <> b OR a_part <> b_part))")
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def dbscan(templates: DataFrame, near: DataFrame, min_points: int = 1, members: DataFrame | None = None) -> DataFrame:
    """(template_id, cluster): components of core templates and their neighbours, named by their least member.

    A template is core with min_points neighbours or more; one that is near no core, singletons included, is a
    cluster of its own; one near several joins its least core's. With min_points 1 these are the connected components.
    With members (template_id, rep), near holds pairs of representatives, which stand for all of their classes: members
    of a class are each other's neighbours and share those of their representative, the least of them.
    """
    near = written(near.select("a", "b"), "dbscan-near")
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if members is None:
        members = templates.select("template_id", F.col("template_id").alias("rep"))
        degree = both.groupBy("a").agg(F.count("*").alias("n"))
    else:
        sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
        beside = both.join(sizes.withColumnRenamed("rep", "b"), "b").select("a", "n")
        own = sizes.where("n > 1").select(F.col("rep").alias("a"), (F.col("n") - 1).alias("n"))
        degree = beside.unionByName(own).groupBy("a").agg(F.sum("n").alias("n"))
    core = degree.where(F.col("n") >= min_points).select(F.col("a").alias("template_id"))
    links = both.join(core.withColumnRenamed("template_id", "a"), "a", "left_semi").join(core.withColumnRenamed("template_id", "b"), "b", "left_semi")
    labels = written(core.withColumn("label", F.col("template_id")), "dbscan")
    links = written(links, "dbscan-links")
    while True:
        lower = links.join(labels.withColumnRenamed("template_id", "a"), "a").groupBy(F.col("b").alias("template_id")).agg(F.min("label").alias("near"))
        step = labels.join(lower, "template_id", "left").select("template_id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid"))
        jump = labels.select(F.col("template_id").alias("mid"), F.col("label").alias("far"))
        step = written(step.join(jump, "mid").select("template_id", F.least("mid", "far").alias("label"), "old"), "dbscan")
        changed = step.where("label != old").limit(1).count()
        labels = step.select("template_id", "label")
        if not changed:
            break
    edge = both.join(labels.withColumnRenamed("template_id", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.min(F.struct("b", "label"))["label"].alias("beside"))
    out = members.join(labels.withColumnRenamed("template_id", "rep"), "rep", "left").join(edge, "rep", "left")
    out = out.select("template_id", F.coalesce("label", "beside", "template_id").alias("core"))
    least = out.groupBy("core").agg(F.min("template_id").alias("cluster"))
    return out.join(least, "core").select("template_id", "cluster")


def cluster(feature_rows: DataFrame, rho: float, bound: int = 1, min_points: int = 1) -> DataFrame:
    """(template_id, cluster); templates with fewer than `bound` points are not yet clustered: -1."""
    long = feature_rows.where(F.size("feature") >= bound)
    short = feature_rows.where(F.size("feature") < bound).select("template_id", F.lit(-1).cast("long").alias("cluster"))
    if rho > 0:
        curves, members = equal_curves(long)
        near = _component_links(curves, rho) if min_points == 1 else _near_curves(curves, rho)
        found = dbscan(curves, near, min_points, members)
    else:
        found = long.select("template_id", F.col("template_id").alias("cluster"))  # no distance is below rho
    found = found.select("template_id", F.col("cluster").cast("long"))
    return found.unionByName(short)


def centers(series: DataFrame, assigned: DataFrame) -> DataFrame:
    """(cluster, back, total): sums of the members' series, aligned at their last points (back = 0)."""
    last = series.groupBy("template_id").agg(F.max("t").alias("last"))
    aligned = series.join(last, "template_id").withColumn("back", F.col("last") - F.col("t"))
    return aligned.join(assigned.where("cluster >= 0"), "template_id").groupBy("cluster", "back").agg(F.sum("rate").alias("total"))


def add_newest(center_rows: DataFrame, newest: DataFrame, assigned: DataFrame) -> DataFrame:
    """Centers one step on: all points move back by one, the newest point is the sum of the members' newest rates."""
    moved = center_rows.select("cluster", (F.col("back") + 1).alias("back"), "total")
    added = newest.join(assigned.where("cluster >= 0"), "template_id").groupBy("cluster").agg(F.sum("rate").alias("total"))
    return moved.unionByName(added.select("cluster", F.lit(0).cast("long").alias("back"), "total"))


@dataclass
class ClusterState:
    """Assignments, centers and sizes on the driver: templates number in the hundreds here."""

    rho: float
    bound: int = 1
    last: int | None = None
    assigned: dict[int, int] = field(default_factory=dict)
    centers: dict[int, np.ndarray] = field(default_factory=dict)
    log: list[tuple[int, int, int]] = field(default_factory=list)

    def _feature(self, x: np.ndarray) -> np.ndarray:
        return x if self.last is None else x[-self.last :]

    def _aligned(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([np.zeros(max(0, n - len(x))), x[-n:] if n else x[:0]])

    def sizes(self) -> dict[int, int]:
        out = dict.fromkeys(self.centers, 0)
        for c in self.assigned.values():
            if c in out:
                out[c] += 1
        return out

    def adjust(self, templates: Mapping[int, np.ndarray]) -> None:
        """One round: members that drifted away leave, unassigned ones join the first center within rho or open a
        cluster of their own, and centers within rho of each other are merged."""
        series = {t: np.asarray(x, float) for t, x in templates.items()}
        near = lambda c, t: dtw(self._feature(self.centers[c]), self._feature(series[t])) < self.rho
        following = max(self.centers, default=-1) + 1
        for t in sorted(series):
            now = self.assigned.get(t, -1)
            if now != -1:
                if self.sizes()[now] == 1 or near(now, t):
                    continue
                self.centers[now] = self.centers[now] - self._aligned(series[t], len(self.centers[now]))
                self.assigned[t] = -1
                self.log.append((t, now, -1))
            if len(series[t]) < self.bound:
                self.assigned[t] = -1
                continue
            home = next((c for c in sorted(self.centers) if near(c, t)), None)
            if home is None:
                home, following = following, following + 1
                self.centers[home] = np.zeros(len(series[t]))
            n = max(len(self.centers[home]), len(series[t]))
            self.centers[home] = self._aligned(self.centers[home], n) + self._aligned(series[t], n)
            self.assigned[t] = home
            self.log.append((t, -1, home))
        self._merge()

    def _merge(self) -> None:
        parent = {c: c for c in self.centers}

        def root(c: int) -> int:
            while parent[c] != c:
                c = parent[c]
            return c

        names = sorted(self.centers)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if root(a) != root(b) and dtw(self._feature(self.centers[a]), self._feature(self.centers[b])) < self.rho:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
        for c in names:
            r = root(c)
            if r != c:
                n = max(len(self.centers[r]), len(self.centers[c]))
                self.centers[r] = self._aligned(self.centers[r], n) + self._aligned(self.centers.pop(c), n)
                for t, home in self.assigned.items():
                    if home == c:
                        self.assigned[t] = r
                        self.log.append((t, c, r))

    def trace(self, newest: Mapping[int, float]) -> None:
        """Appends to each center the sum of its members' newest points."""
        for c in self.centers:
            self.centers[c] = np.append(self.centers[c], sum(v for t, v in newest.items() if self.assigned.get(t) == c))
