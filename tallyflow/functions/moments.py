"""ln phi of the layered mixture for any order, layer and argument, from a small table.

phi_r^(L)(e^u) = E[Y^r exp(-Y e^u)], Y a product of L unit exponentials, is the line integral of
Gamma(s) Gamma(p - s)^L e^{-su} / (2 pi i) over 0 < Re s < p, p = r + 1. With x the root of ln x - L ln(1 - x) = w,
w = u + (L - 1) ln p, its leading part is L lnGamma(p) + p (L ln(1 - x) + (L - 1) x). What is left is of the order of
one and smooth in ln p and in z = ln x - ln(1 - x) for all p, so it is held for the first orders and for orders in
a constant ratio, and interpolated between them: a bounded table serves counts of any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.sources.tables import cut

#: Orders held one by one; beyond them p grows by RATIO. Grid of z, and neighbours of an interpolation.
EACH, RATIO = 24, 1.25
Z_LOW, Z_STEP, Z_COUNT = -44.0, 0.2, 421
NODES = 8
#: Arguments from U_MOST + U_LAYER L on aren't computed: at an integrand's peak the p - s of all symbols are one on
#: average, which is reached near ln count + 0.58 L; neighbours of an interpolation lie at up to 1.5 L more.
U_MOST, U_LAYER = 24.0, 2.4
#: Step of a line integral in widths of its pass.
SPACING = 0.7
HALF_LN_2PI = 0.5 * math.log(2 * math.pi)


def _series(v: np.ndarray) -> np.ndarray:
    v2 = 1 / (v * v)
    return (1 / 12 - v2 * (1 / 360 - v2 * (1 / 1260 - v2 * (1 / 1680 - v2 * (1 / 1188 - v2 * (691 / 360360 - v2 / 156)))))) / v


def _tail(s: np.ndarray) -> np.ndarray:
    """lnGamma(s) - [(s - 1/2) ln s - s + ln(2 pi) / 2] for Re s > 0."""
    near = s.real**2 + s.imag**2 < 100
    if not near.any():
        return _series(s)
    out = np.empty_like(s)
    out[~near] = _series(s[~near])
    v = s[near]
    y = v + 10
    product = v.copy()
    for k in range(1, 10):
        product *= v + k
    out[near] = (y - 0.5) * np.log(y) - 10 + _series(y) - np.log(product) - (v - 0.5) * np.log(v)
    return out


def _log_gamma(s: np.ndarray) -> np.ndarray:
    """lnGamma(s), real part right and phase up to whole turns, also for -1 < Re s < 0."""
    y = s + 1
    return (y - 0.5) * np.log(y) - y + HALF_LN_2PI + _tail(y) - np.log(s)


def _exponent(s: np.ndarray, p: float, layers: int, w: np.ndarray) -> np.ndarray:
    """ln of the integrand over Gamma(p)^L: lnGamma(s) - s u + L (lnGamma(p - s) - lnGamma(p)), without large terms that cancel."""
    q = p - s
    fall = (q - 0.5) * np.log1p(-s / p) + s + _tail(q) - _tail(np.array([complex(p)]))[0]
    return _log_gamma(s) - s * (w + math.log(p)) + layers * fall


def _beside(step: np.ndarray, x: np.ndarray, rest: np.ndarray, p: float, layers: int) -> np.ndarray:
    """The same at s = p (x + step), rest = 1 - x, with the leading part taken off: no term is larger than the root of p."""
    s, q = p * (x + step), p * (rest - step)
    lead = p * ((x + step) * np.log1p(step / x) + layers * (rest - step) * np.log1p(-step / rest) + step * (layers - 1))
    return lead - 0.5 * np.log(s) + HALF_LN_2PI + _tail(s) - 0.5 * layers * np.log(q / p) + layers * (_tail(q) - _tail(np.array([complex(p)]))[0])


def _digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of lnGamma for x > 0."""
    y = x + 8
    i2 = 1 / (y * y)
    out = np.log(y) - 0.5 / y - i2 * (1 / 12 - i2 * (1 / 120 - i2 / 252))
    for k in range(8):
        out -= 1 / (x + k)
    return out


def _pass(z: np.ndarray, w: np.ndarray, p: float, layers: int) -> tuple[np.ndarray, np.ndarray]:
    """(s, p - s) of the lowest pass between the poles at 0 and p, by halving around z; kept off the poles."""
    low, high = z - 7.0, z + 7.0
    u = w - (layers - 1) * math.log(p)
    for _ in range(24):
        middle = 0.5 * (low + high)
        s, q = p / (1 + np.exp(-middle)), p / (1 + np.exp(middle))
        over = _digamma(s) - layers * _digamma(q) > u
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    s, q = p / (1 + np.exp(-middle)), p / (1 + np.exp(middle))
    q = np.where(s < q, p - np.clip(s, min(0.2, 0.3 * p), None), np.clip(q, min(0.2, 0.3 * p), None))
    return np.where(s < q, np.clip(s, min(0.2, 0.3 * p), None), p - q), q


def _line(value, width: np.ndarray) -> np.ndarray:
    """(1 / pi) times the integral over y > 0 of Re exp(value(y)) by the trapezoid of step ``width``, as far as it counts."""
    rows = np.arange(len(width))
    first = value(rows, np.zeros((len(width), 1)))
    scale = first.real.copy()
    total = 0.5 * np.exp(first - scale).real.sum(1)
    k = 1
    while len(rows):
        y = width[rows, None] * np.arange(k, k + 16)
        term = np.exp(value(rows, y) - scale[rows])
        total[rows] += term.real.sum(1)
        k += 16
        rows = rows[np.abs(term[:, -1]) > 1e-17] if k < 6000 else rows[:0]
    return scale[:, 0] + np.log(np.abs(total * width / math.pi) + 1e-300), np.sign(total)


def _z_grid() -> np.ndarray:
    return Z_LOW + Z_STEP * np.arange(Z_COUNT)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def column(p: float, depth: int) -> np.ndarray:
    """depth x Z_COUNT: what ln phi of order p - 1 is beyond its leading part, on the grid of z, layers 1..depth."""
    out = np.zeros((depth, Z_COUNT))
    z = _z_grid()
    x, rest = np.exp(-_softplus(-z)), np.exp(-_softplus(z))
    for layers in range(2, depth + 1):
        w = -_softplus(-z) + layers * _softplus(z)
        lead = p * (-layers * _softplus(z) + (layers - 1) * x)
        res = np.zeros(Z_COUNT)
        # Left: what the pole at 0 leaves, 1 - phi / Gamma(p)^L, is small and taken on a line left of it.
        left = (p * x < 0.4) | (x < 0.02) & (p * x < 0.7)
        live = np.flatnonzero(left & (w + math.log(p) > -80))
        if len(live):
            # Near the lowest pass between the poles at -1 and 0, whose place a quadratic gives; not too near to either.
            b = w[live] + math.log(p)
            b = np.where(np.abs(b) < 1e-3, 1e-3, b)
            c = np.clip((np.sqrt(b * b + 4) - b - 2) / (2 * b), -0.7, -0.25)
            k2 = 1 / c**2 + 1 / (1 + c) ** 2 + layers * (1 / (p - c) + 0.5 / (p - c) ** 2)
            width = np.minimum(SPACING / np.sqrt(k2), 2 * math.pi * np.minimum(-c, 1 + c) / 34)
            size, sign = _line(lambda rows, y: _exponent(c[rows, None] + 1j * y, p, layers, w[live[rows], None]), width)
            res[live] = np.where((size < -0.02) | (sign > 0), np.log1p(sign * np.exp(np.minimum(size, -1e-9))) - lead[live], np.nan)
        within = w - (layers - 1) * math.log(p) < U_MOST + U_LAYER * layers
        right = np.flatnonzero((~left | np.isnan(res)) & within)
        if len(right):
            c, away = _pass(z[right], w[right], p, layers)
            shift = np.where(x[right] > 0.5, rest[right] - away / p, c / p - x[right])
            three = lambda v: 1 / v**2 + 1 / (1 + v) + 0.5 / (1 + v) ** 2
            width = np.minimum(SPACING / np.sqrt(three(c) + layers * three(away)), 2 * math.pi * np.minimum(c, away) / 34)
            res[right] = _line(lambda rows, y: _beside(shift[rows, None] + 1j * y / p, x[right[rows], None], rest[right[rows], None], p, layers), width)[0]
        if not within.all():
            res[~within] = res[np.flatnonzero(within)[-1]]
        out[layers - 1] = res
    return out


def node_orders(most: int) -> np.ndarray:
    """The p of all columns that counts up to ``most`` need."""
    far = max(0, math.ceil(math.log(max(most + 2, EACH + 1) / EACH) / math.log(RATIO))) + NODES
    return np.r_[np.arange(1, EACH), EACH * RATIO ** np.arange(-(NODES // 2), far)]


_BUILT: dict[tuple, Table] = {}


def build_distributed(spark: SparkSession, depth: int, most: int) -> Table:
    """The table with its columns computed by the cluster: at most some 150 rows of depth x Z_COUNT numbers."""
    spark_id = spark.sparkContext.applicationId
    # Rounded up, so that the tables of a session's queries are few.
    most = 1 << (4 * math.ceil(int(most).bit_length() / 4))
    if (spark_id, depth, most) in _BUILT:
        return _BUILT[spark_id, depth, most]
    orders = node_orders(most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["id"], "column": [column(float(orders[k]), depth).reshape(-1) for k in b["id"]]})

    parts = spark.range(len(orders)).repartition(len(orders), F.col("id"))
    rows = cut(parts.mapInPandas(run, "k bigint, column array<double>"), "moments").toPandas().sort_values("k")
    table = Table(np.stack(rows["column"].to_numpy()).reshape(len(orders), depth, Z_COUNT), most)
    if len(_BUILT) >= 8:
        _BUILT.clear()
    _BUILT[spark_id, depth, most] = table
    return table


def _lagrange(fraction: np.ndarray) -> np.ndarray:
    """Weights of NODES neighbours at a place ``fraction`` of the way between the two middle ones; last axis: neighbours."""
    at = np.arange(NODES) - (NODES // 2 - 1)
    away = fraction[..., None] - at
    out = np.empty(away.shape)
    for i in range(NODES):
        scale = math.prod(int(at[i] - at[j]) for j in range(NODES) if j != i)
        out[..., i] = np.prod(np.delete(away, i, -1), axis=-1) / scale
    return out


class Table:
    """ln phi for counts up to ``most`` and layers up to ``depth``."""

    def __init__(self, columns: np.ndarray, most: int):
        self.columns, self.most = columns, most
        self.depth = columns.shape[1]
        self.held: dict[int, np.ndarray] = {}

    def beyond(self, count: int) -> np.ndarray:
        """depth x Z_COUNT of one count: a column of the table, or an interpolation between NODES of them in ln p."""
        if count + 1 < EACH:
            return self.columns[count]
        got = self.held.get(count)
        if got is None:
            place = math.log((count + 1) / EACH) / math.log(RATIO)
            low = math.floor(place)
            first = EACH - 1 + NODES // 2 + low - (NODES // 2 - 1)
            got = np.tensordot(_lagrange(np.array(place - low)), self.columns[first : first + NODES], 1)
            if len(self.held) > 400:
                self.held.clear()
            self.held[count] = got
        return got


class Direct:
    """The same for a few counts, each computed in this process when it is first asked for."""

    def __init__(self, depth: int):
        self.depth = depth
        self.beyond = lru_cache(maxsize=256)(lambda count: column(count + 1.0, depth))


def place(w: np.ndarray, layers: np.ndarray, start: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """z with ln x - L ln(1 - x) = w, x = 1 / (1 + e^-z), by Newton's rule."""
    z = np.where(w < 0, w, w / layers) if start is None else start
    for _ in range(steps):
        x = 1 / (1 + np.exp(-z))
        move = (-_softplus(-z) + layers * _softplus(z) - w) / (1 - x + layers * x)
        z = z - move
        if np.abs(move).max(initial=0) < 1e-13 * (1 + np.abs(z).max(initial=0)):
            break
    return z
