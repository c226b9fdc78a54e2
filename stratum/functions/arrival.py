"""Arrival-rate patterns as Column expressions over a time step `t` (0, 1, 2, ...), and sampled pattern parameters.

All series are long frames (template_id, t, rate); the noise-free parts are closed forms. Noise comes from seeded
Spark functions, so a series is the same for the same seed and partitioning of spark.range.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP_MINUTES = 5
DAY = 24 * 60 // STEP_MINUTES
WEEK = 7 * DAY


def toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def stability(center: float, noise: str | None = None, params: Sequence[float] = (), seed: int = 0) -> Column:
    """A level with normal noise (mu, sigma, scale), cut toward zero, or uniform integers [low, high); never below 0."""
    level = F.lit(float(center))
    if noise == "gaussian":
        mu, sigma, scale = params
        level = toward_zero(level + scale * (mu + sigma * F.randn(seed)))
    elif noise == "random":
        low, high = params
        level = level + low + F.floor(F.rand(seed) * (high - low))
    elif noise is not None:
        raise ValueError(f"unknown noise: {noise}")
    return F.greatest(F.lit(0.0), level)


def component(t: Column, center: float, width: float, scale: float) -> Column:
    """A bell curve of area `scale` whose standard deviation is half the width."""
    half = width / 2
    return scale / (math.sqrt(2 * math.pi) * half) * F.exp(-((t - center) ** 2) / (2 * half * half))


def cycle(t: Column, parts: Mapping[int, Sequence[tuple[float, float, float]]], bias: float = 0.0, sigma: float = 0.0, mu: float = 0.0, seed: int = 0) -> Column:
    """bias plus, for each period, its components at t mod period.

    With sigma, each component of each place in a period has normal noise of its own, the same in every repetition.
    """
    out = F.lit(float(bias))
    for k, (period, components) in enumerate(sorted(parts.items())):
        place = F.pmod(t, F.lit(int(period)))
        for j, (center, width, scale) in enumerate(components):
            out = out + component(place, center, width, scale)
            if sigma or mu:
                out = out + mu + sigma * normal(place, seed + 1000 * k + j)
    return out


def normal(key: Column, seed: int) -> Column:
    """A standard normal number that depends on the key and the seed alone."""
    u = (F.pmod(F.xxhash64(key, F.lit(2 * seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    v = (F.pmod(F.xxhash64(key, F.lit(2 * seed + 1)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def spike_height(center: float, level: Column | float, scale: float) -> Column:
    level = level if isinstance(level, Column) else F.lit(float(level))
    return center / (1 + F.exp(level)) * scale


def add_spikes(series: DataFrame, spikes: DataFrame, shape: str) -> DataFrame:
    """series (template_id, t, rate) plus spikes (template_id, start, height, length).

    A random spike decays as exp(-i / 3), a periodic one as cos(pi i / (2 length)), over its length. Spikes are
    spread over their steps and summed before one join, so a series is shuffled once whatever spikes it has.
    """
    i = F.col("i")
    if shape == "random":
        decay = F.exp(-i / 3)
    elif shape == "cycle":
        decay = F.cos(F.lit(math.pi) / (2 * F.col("length")) * i)
    else:
        raise ValueError(f"unknown spike shape: {shape}")
    spread = spikes.where("length > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("length").cast("int") - 1)))
    extra = spread.groupBy("template_id", (F.col("start") + i).alias("t")).agg(F.sum(F.col("height") * decay).alias("extra"))
    return series.join(extra, ["template_id", "t"], "left").select("template_id", "t", (F.col("rate") + F.coalesce("extra", F.lit(0.0))).alias("rate"))


def steps(spark: SparkSession, size: int) -> DataFrame:
    return spark.range(size).select(F.col("id").alias("t"))


def random_spikes(size: int, center: float, scale: float, bounds: tuple[int, int], rng: np.random.Generator) -> list[tuple[int, float, int]]:
    """(start, height, length) of spikes at random gaps."""
    out, cursor = [], 0
    while cursor + bounds[0] < size:
        cursor += int(rng.integers(bounds[0], max(bounds[0] + 1, size - cursor)))
        out.append((cursor, center / (1 + math.exp(rng.normal())) * scale, int(rng.integers(*bounds))))
    return out


def periodic_spikes(size: int, center: float, scale: float, period: int, shift: int, bounds: tuple[int, int], rng: np.random.Generator) -> list[tuple[int, float, int]]:
    """(start, height, length) of spikes each period, give or take the shift."""
    out, cursor = [], 0
    while cursor + period - shift < size:
        cursor += period + int(rng.integers(-shift, shift + 1))
        out.append((cursor, center / (1 + math.exp(rng.normal())) * scale, int(rng.integers(*bounds))))
    return out


@dataclass(frozen=True)
class PatternConfig:
    """Bounds from which pattern parameters are drawn; level classes are (probability, low, high)."""

    levels: Mapping[str, tuple[float, int, int]] = field(default_factory=lambda: {"high": (0.2, 200, 400), "middle": (0.3, 50, 200), "low": (0.5, 5, 50)})
    noise: tuple[float, float, float] = (0.0, 1.0, 2.0)
    spike_scale: float = 3.0
    spike_length: tuple[int, int] = (6, 24)
    spike_period: Mapping[str, tuple[float, int, int]] = field(default_factory=lambda: {"day": (0.6, DAY, 6), "week": (0.4, WEEK, 36)})
    cycles: Mapping[str, int] = field(default_factory=lambda: {"day": DAY, "week": WEEK})
    centers: Mapping[str, Mapping[int, float]] = field(default_factory=lambda: {"day": {h: 1.0 + (8 <= h <= 20) for h in range(24)}, "week": {d: 1.0 + (d < 5) for d in range(7)}})
    shift: Mapping[str, int] = field(default_factory=lambda: {"day": 6, "week": 72})
    width: Mapping[str, tuple[int, int]] = field(default_factory=lambda: {"day": (12, 72), "week": (144, 576)})
    scale: Mapping[str, tuple[int, int]] = field(default_factory=lambda: {"day": (500, 5000), "week": (2000, 20000)})


@dataclass(frozen=True)
class Pattern:
    template_id: int
    kind: str
    bias: float
    noise: tuple[float, float, float]
    parts: Mapping[int, tuple[tuple[float, float, float], ...]] = field(default_factory=dict)
    spikes: tuple[tuple[int, float, int], ...] = ()


KINDS = ("stability", "spike_random", "spike_cycle", "cycle")


def sample_patterns(templates: int, size: int, seed: int = 0, kinds: Mapping[int, str] | None = None, config: PatternConfig = PatternConfig()) -> list[Pattern]:
    """Pattern parameters of each template: a frequency class by its weight, a level in its bounds, and by kind either
    spikes or one to three peaks a day (40 %), a week (20 %) or both (40 %)."""
    rng = np.random.default_rng(seed)
    names = sorted(config.levels)
    weights = np.array([config.levels[n][0] for n in names])
    out = []
    for i in range(1, templates + 1):
        kind = (kinds or {}).get(i) or KINDS[int(rng.integers(len(KINDS)))]
        if kind not in KINDS:
            raise ValueError(f"unknown pattern: {kind}")
        _, low, high = config.levels[names[int(rng.choice(len(names), p=weights / weights.sum()))]]
        bias = float(rng.integers(low, high + 1))
        spikes: list[tuple[int, float, int]] = []
        parts: dict[int, tuple[tuple[float, float, float], ...]] = {}
        if kind == "spike_random":
            spikes = random_spikes(size, bias, config.spike_scale, config.spike_length, rng)
        elif kind == "spike_cycle":
            periods = sorted(config.spike_period)
            chance = np.array([config.spike_period[p][0] for p in periods])
            _, period, shift = config.spike_period[periods[int(rng.choice(len(periods), p=chance / chance.sum()))]]
            spikes = periodic_spikes(size, bias, config.spike_scale, period, shift, config.spike_length, rng)
        elif kind == "cycle":
            draw = rng.random()
            for name in ["day"] if draw < 0.4 else ["week"] if draw < 0.6 else ["day", "week"]:
                period, places = config.cycles[name], sorted(config.centers[name])
                chance = np.array([config.centers[name][p] for p in places], float)
                unit, peaks = period / len(places), []
                for _ in range(min(int(rng.zipf(2)), 3)):
                    at = places[int(rng.choice(len(places), p=chance / chance.sum()))] * unit
                    shift = config.shift[name]
                    center = rng.integers(max(0, int(at) - shift), min(period, int(at) + shift) + 1)
                    peaks.append((float(center), float(rng.integers(*config.width[name])), float(rng.integers(*config.scale[name]))))
                parts[period] = tuple(peaks)
        out.append(Pattern(i, kind, bias, config.noise, parts, tuple(spikes)))
    return out


def arrival_rates(spark: SparkSession, patterns: Sequence[Pattern], size: int, seed: int = 0, noisy: bool = True) -> DataFrame:
    """(template_id, t, rate) of all patterns as one plan: parameters as rows, joined with the steps; nulls and
    negative rates become 0."""
    base = spark.createDataFrame([(p.template_id, p.bias, *p.noise, p.kind) for p in patterns], "template_id int, bias double, mu double, sigma double, spread double, kind string")
    peaks = [(p.template_id, int(period), *map(float, c)) for p in patterns for period, cs in p.parts.items() for c in cs]
    spikes = [(p.template_id, int(s), float(h), int(n), p.kind) for p in patterns for s, h, n in p.spikes]
    grid = steps(spark, size).join(F.broadcast(base), how="cross")  # one row per template
    key = F.struct("template_id", "t")
    noise = F.col("spread") * (F.col("mu") + F.col("sigma") * normal(F.xxhash64(key), seed)) if noisy else F.lit(0.0)
    level = F.when(F.col("kind") == "cycle", F.col("bias") + (F.col("mu") + F.col("sigma") * normal(F.xxhash64(key), seed) if noisy else F.lit(0.0)))
    level = level.otherwise(F.greatest(F.lit(0.0), toward_zero(F.col("bias") + noise)))
    series = grid.select("template_id", "t", level.alias("rate"))
    if peaks:
        rows = spark.createDataFrame(peaks, "template_id int, period int, center double, width double, scale double")
        half, place = F.col("width") / 2, F.pmod(F.col("t"), F.col("period"))
        bell = F.col("scale") / (math.sqrt(2 * math.pi) * half) * F.exp(-((place - F.col("center")) ** 2) / (2 * half * half))
        extra = steps(spark, size).join(F.broadcast(rows), how="cross").groupBy("template_id", "t").agg(F.sum(bell).alias("extra"))
        series = series.join(extra, ["template_id", "t"], "left").select("template_id", "t", (F.col("rate") + F.coalesce("extra", F.lit(0.0))).alias("rate"))
    for kind, shape in (("spike_random", "random"), ("spike_cycle", "cycle")):
        mine = [s[:4] for s in spikes if s[4] == kind]
        if mine:
            series = add_spikes(series, spark.createDataFrame(mine, "template_id int, start long, height double, length int"), shape)
    return series.select("template_id", "t", F.greatest(F.lit(0.0), F.coalesce(F.nanvl("rate", F.lit(0.0)), F.lit(0.0))).alias("rate"))


def wide(series: DataFrame, templates: Sequence[int], value: str = "rate", step: int = STEP_MINUTES) -> DataFrame:
    """One row per step: time in minutes and a column for each template."""
    return series.groupBy((F.col("t") * step).alias("time")).pivot("template_id", list(templates)).agg(F.first(value))
