"""Estimates from stratified anchors, extrapolation to age zero, decay fits and a lattice search."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Anchor:
    """A sampled position: its stratum [start, stop), and the share of the stratum that was sampled."""

    number: int
    stratum: int
    start: int
    stop: int
    position: int
    inclusion: float

    @property
    def weight(self) -> float:
        return 1.0 / self.inclusion


def design_anchors(n: int, least_prefix: int, window: int, early: int, late: int, each: int, seed: int = 0) -> list[Anchor]:
    """Anchors at random places of ``early`` strata that grow by a constant ratio and ``late`` equal ones.

    Eligible positions are [least_prefix, n - window]; early strata cover the first twentieth of n of them. Every
    stratum gives ``each`` distinct anchors; the weights add up to the eligible positions.
    """
    last = n - window + 1
    turn = min(least_prefix + max(early, n // 20), last - late)
    ratio = (turn / least_prefix) ** (1 / early)
    edges = [round(least_prefix * ratio**k) for k in range(early)] + [turn + round((last - turn) * k / late) for k in range(late + 1)]
    rng = np.random.default_rng(seed)
    out: list[Anchor] = []
    for s, (a, b) in enumerate(zip(edges, edges[1:])):
        if b - a < each:
            raise ValueError("a stratum is smaller than its sample")
        out += [Anchor(len(out) + i, s, a, b, a + int(p), each / (b - a)) for i, p in enumerate(sorted(rng.choice(b - a, each, replace=False)))]
    return out


def stratified_estimate(values: DataFrame, populations: DataFrame) -> DataFrame:
    """``population, estimate, total, standard_error, low, high``: stratified mean with finite-population correction.

    values: ``stratum, value`` of sampled units; populations: ``stratum, size``. A stratum with one value has no
    variance. Strata without values don't count towards the population.
    """
    each = values.filter("value is not null").groupBy("stratum").agg(F.count("*").alias("k"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"))
    joined = each.join(populations, "stratum")
    size = F.col("size").cast("double")
    var = size * size * (1 - F.col("k") / size) * F.col("var") / F.col("k")
    whole = joined.agg(F.sum("size").alias("population"), F.sum(size * F.col("mean")).alias("total"), F.sqrt(F.sum(var)).alias("sd"))
    est, se = F.col("total") / F.col("population"), F.col("sd") / F.col("population")
    return whole.select("population", est.alias("estimate"), "total", se.alias("standard_error"), (est - 1.96 * se).alias("low"), (est + 1.96 * se).alias("high"))


def bootstrap_interval(values: DataFrame, populations: DataFrame, replicates: int = 2000, seed: int = 0) -> DataFrame:
    """``low, high, jack_low, jack_high``: bootstrap interval within strata, and the range when one stratum is left out.

    Each stratum is resampled by a task of its own; only the replicate means (a fixed number a stratum)
    meet, so no task sees all anchors.
    """
    with_size = values.filter("value is not null").join(populations, "stratum")

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, zlib.crc32(str(pdf["stratum"].iloc[0]).encode())])
        x = pdf["value"].to_numpy(float)
        means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(replicates)])
        size = float(pdf["size"].iloc[0])
        return pd.DataFrame({"replicate": np.r_[-1, np.arange(replicates)], "size": size, "weighted": np.r_[x.mean(), means] * size})

    rows = with_size.groupBy("stratum").applyInPandas(resample, "replicate int, size double, weighted double")
    each = rows.groupBy("replicate").agg((F.sum("weighted") / F.sum("size")).alias("estimate"))
    boot = each.filter("replicate >= 0").agg(F.percentile("estimate", 0.025).alias("low"), F.percentile("estimate", 0.975).alias("high"))
    own = rows.filter("replicate = -1")
    sums = own.agg(F.struct(F.sum("weighted").alias("w"), F.sum("size").alias("s")).alias("t"))
    left = own.withColumn("t", sums.scalar()).filter("t.s > size").select(((F.col("t.w") - F.col("weighted")) / (F.col("t.s") - F.col("size"))).alias("e"))
    jack = left.agg(F.struct(F.min("e").alias("a"), F.max("e").alias("b")).alias("j"))
    return boot.withColumn("j", jack.scalar()).select("low", "high", F.col("j.a").alias("jack_low"), F.col("j.b").alias("jack_high"))


def zero_age(rings: Iterable[tuple[float, float, float, float]], prefix: float) -> dict[str, float]:
    """Loss at age zero from rings (start, stop, tokens, mean): weighted straight and quadratic fits.

    The age of a ring is the middle of its offsets start..stop - 1 relative to the prefix; tokens are the weights. A quadratic needs
    three rings, a straight line two; what can't be fitted is nan.
    """
    rows = np.array([r for r in rings if r[2] > 0], float).reshape(-1, 4)
    age, weight = (rows[:, 0] + rows[:, 1] - 1) / 2 / prefix, rows[:, 2]
    out = {}
    for name, degree in (("linear", 1), ("quadratic", 2)):
        out[name] = float(np.polyfit(age, rows[:, 3], degree, w=np.sqrt(weight))[-1]) if len(rows) > degree else math.nan
    return out


def decay_fits(by_lag: DataFrame, lag: str = "lag", value: str = "bits") -> DataFrame:
    """``power_slope, power_scale, exp_slope, exp_scale``: value = a lag^s and value = a e^{s lag}, by least squares on logs."""
    rows = by_lag.filter(F.col(value) > 0).select(F.col(lag).cast("double").alias("x"), F.log(F.col(value)).alias("y"))
    return rows.agg(F.regr_slope("y", F.log("x")).alias("power_slope"), F.exp(F.regr_intercept("y", F.log("x"))).alias("power_scale"), F.regr_slope("y", "x").alias("exp_slope"), F.exp(F.regr_intercept("y", "x")).alias("exp_scale"))


def decay_with_offset(lags: Iterable[float], values: Iterable[float], steps: int = 200) -> tuple[float, float, float]:
    """(offset, scale, slope) of value = offset + scale lag^slope: the offset by search, the others by logs."""
    x, y = np.log(np.array(list(lags), float)), np.array(list(values), float)
    best = (math.inf, 0.0, 0.0, 0.0)
    for c in np.linspace(0, y.min() * (1 - 1e-6), steps):
        slope, intercept = np.polyfit(x, np.log(y - c), 1)
        error = float(((c + np.exp(intercept + slope * x) - y) ** 2).sum())
        if error < best[0]:
            best = (error, float(c), float(np.exp(intercept)), float(slope))
    return best[1:]


def lattice_search(start: tuple[int, ...], cost: Callable[[tuple[int, ...]], float], low: tuple[int, ...], high: tuple[int, ...], valid: Callable[[tuple[int, ...]], bool] = lambda p: True) -> tuple[tuple[int, ...], dict]:
    """The best point reached from ``start`` by doubling or halving one coordinate while that helps.

    A halved coordinate at its lower bound becomes 0 if 0 is allowed (``low``), and 0 doubles to 1. Each point is
    evaluated once; the second result holds them all. Ties keep the point found first.
    """
    known: dict[tuple[int, ...], float] = {}

    def at(p: tuple[int, ...]) -> float:
        if p not in known:
            known[p] = cost(p)
        return known[p]

    here = start
    while True:
        near = []
        for i, v in enumerate(here):
            for w in (max(1, 2 * v), v // 2):
                p = (*here[:i], w, *here[i + 1 :])
                if w != v and low[i] <= w <= high[i] and valid(p):
                    near.append(p)
        best = min(near, key=at, default=here)
        if at(best) >= at(here):
            return here, known
        here = best
