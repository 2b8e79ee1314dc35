"""The depth-averaged layered mixture: log2 probability of a count profile.

With Y a product of L unit exponentials and phi_r(t) = E[Y^r exp(-tY)], a profile m_1..m_s of N counts
over d symbols has probability q_L = 1/Gamma(N) Int e^{Nu} phi_0(e^u)^(d-s) Prod phi_{m_i}(e^u) du; the
mixture averages q_L over L = 1..L_max(d). All layers of a profile are taken together: the peaks of their
integrands are found by Newton's rule, and each integral is a sum over equally spaced arguments around its
peak, as far as they count. ln phi comes from a table of bounded size (``moments``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import moments
from tallyflow.functions.moments import Direct, Table
from tallyflow.sources.tables import cut

EULER = 0.5772156649015329
LN2 = math.log(2.0)
#: Spacing of the arguments in widths of the peak and at most, and the arguments of a first pass to each side.
SPACING, WIDEST, SIDE = 0.6, 0.5, 20


def default_depths(d: int) -> int:
    """L_max(d) = max(1, round(2 c ln d)), c = 1/(1 - Euler's constant)."""
    return max(1, round(2 / (1 - EULER) * math.log(d))) if d > 1 else 1


@lru_cache(maxsize=8)
def _direct(depth: int) -> Direct:
    """Moments for single profiles; those of queries come from ``moments.build_distributed``."""
    return Direct(depth)


class Scorer:
    """Scores profiles over ``d`` symbols, given as count classes (counts, how many symbols have each)."""

    def __init__(self, d: int, depths: int, table: Table | Direct):
        if table.depth < depths:
            raise ValueError("the table has too few layers")
        self.d, self.depths, self.table = d, depths, table
        self.layers = np.arange(2, depths + 1)

    def _classes(self, counts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, symbols = np.asarray(counts, np.int64), np.asarray(symbols, np.int64)
        counts, symbols = counts[counts > 0], symbols[counts > 0]
        seen = int(symbols.sum())
        if seen > self.d:
            raise ValueError("more symbols than the alphabet has")
        return (np.r_[0, counts], np.r_[self.d - seen, symbols]) if seen < self.d else (counts, symbols)

    def _ln_phi(self, u: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """layers x arguments x counts: ln phi at u (layers x arguments), layers 2.. ."""
        layers = self.layers[:, None, None]
        p = counts + 1.0
        z = moments.place(u[:, :, None] + (layers - 1) * np.log(p), layers)
        x = 1 / (1 + np.exp(-z))
        lead = p * (-layers * np.logaddexp(0.0, z) + (layers - 1) * x)
        lead += layers * np.array([math.lgamma(v) for v in p])
        at = np.clip((z - moments.Z_LOW) / moments.Z_STEP, moments.NODES // 2, moments.Z_COUNT - moments.NODES // 2 - 1)
        low = np.floor(at).astype(np.int64)
        weights = moments._lagrange(at - low)
        rows = np.arange(len(self.layers))[:, None, None]
        held = np.stack([self.table.beyond(int(c))[1 : self.depths] for c in counts], 1)
        which = np.arange(len(counts))
        for k in range(moments.NODES):
            lead += weights[..., k] * held[rows, which, low + (k - moments.NODES // 2 + 1)]
        return lead

    def _peaks(self, n: int, counts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(u, width) of each layer's integrand, where the expected occurrences sum to n, leading parts alone."""
        layers = self.layers[:, None]
        p = counts + 1.0
        mass = symbols * p
        ln_p = np.log(p)
        # ln of the sum rises ever more slowly in u, so Newton's rule from the left doesn't overshoot.
        u = math.log(n) - np.log(mass @ np.exp((self.layers - 1) * (ln_p - ln_p.max())[:, None])) - (self.layers - 1) * ln_p.max()
        z = None
        for _ in range(60):
            w = u[:, None] + (layers - 1) * ln_p
            z = moments.place(w, layers, z, 8) if z is not None else moments.place(w, layers)
            x = 1 / (1 + np.exp(-z))
            total = (mass * x).sum(1)
            slope = (mass * x * (1 - x) / (1 - x + layers * x)).sum(1)
            move = np.minimum((math.log(n) - np.log(total)) * total / slope, 25.0)
            u = u + move
            if np.abs(move).max() < 1e-3:
                break
        return u, 1 / np.sqrt(slope)

    def _integrands(self, n: int, counts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(u, ln of the integrand, spacing), layers x arguments; both ends are too small to count."""
        u, width = self._peaks(n, counts, symbols)
        step = np.minimum(SPACING * width, WIDEST)
        offsets = np.arange(-SIDE, SIDE + 1)
        at = u[:, None] + step[:, None] * offsets
        value = n * at + self._ln_phi(at, counts) @ symbols
        for _ in range(60):
            top = value.max(1)
            left, right = (value[:, 0] > top - 36).any(), (value[:, -1] > top - 36).any()
            if not left and not right:
                break
            for ends, first in ((left, True), (right, False)):
                if ends:
                    more = (at[:, :1] if first else at[:, -1:]) + step[:, None] * (np.arange(-SIDE, 0) if first else np.arange(1, SIDE + 1))
                    new = n * more + self._ln_phi(more, counts) @ symbols
                    at, value = (np.c_[more, at], np.c_[new, value]) if first else (np.c_[at, more], np.c_[value, new])
        return at, value, step

    def _add_one(self, n: int, counts: np.ndarray, symbols: np.ndarray) -> float:
        return math.lgamma(self.d) - math.lgamma(self.d + n) + float(sum(k * math.lgamma(c + 1) for c, k in zip(counts.tolist(), symbols.tolist())))

    def levels(self, counts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """log2 q_L for L = 1..depths. No counts: 0; one count: -log2 d at every depth."""
        counts, symbols = self._classes(counts, symbols)
        n = int((counts * symbols).sum())
        if n == 0:
            return np.zeros(self.depths)
        if n == 1:
            return np.full(self.depths, -math.log2(self.d))
        out = np.empty(self.depths)
        # The first depth is the add-one rule.
        out[0] = self._add_one(n, counts, symbols)
        if self.depths > 1:
            _, value, step = self._integrands(n, counts, symbols)
            top = value.max(1)
            out[1:] = top + np.log(step * np.exp(value - top[:, None]).sum(1)) - math.lgamma(n)
        return out / LN2

    def average(self, counts: np.ndarray, symbols: np.ndarray) -> float:
        """log2 of the average over depths."""
        return _average(self.levels(counts, symbols))

    def next_symbol(self, counts: np.ndarray, symbols: np.ndarray) -> dict[int, float]:
        """Probability of the next symbol per current count c (0: each unseen one): q(c -> c+1) / q.

        All classes share the arguments and the integrand of the profile itself: one more occurrence of a
        symbol with count c multiplies the integrand by e^u phi_{c+1} / phi_c.
        """
        counts, symbols = self._classes(counts, symbols)
        n = int((counts * symbols).sum())
        if n == 0:
            return {0: 1 / self.d}
        base = self._add_one(n, counts, symbols)
        first = base + np.log(counts + 1.0) - math.log(self.d + n)
        grown, whole = first[:, None], np.array([base])
        if self.depths > 1:
            at, value, step = self._integrands(n, counts, symbols)
            gain = at[:, :, None] + self._ln_phi(at, counts + 1) - self._ln_phi(at, counts)
            top = value.max(1)
            shares = np.exp(value - top[:, None])
            # Where n is 1 the profile itself has probability 1/d at every depth; the same sum gives it.
            whole = np.r_[whole, top + np.log(step * shares.sum(1)) - math.lgamma(n)]
            most = gain.max(1)
            more = most + np.log((shares[:, :, None] * np.exp(gain - most[:, None, :])).sum(1)) + (top + np.log(step) - math.lgamma(n + 1))[:, None]
            grown = np.c_[grown, more.T]
        ratio = np.logaddexp.reduce(grown, 1) - np.logaddexp.reduce(whole)
        return dict(zip(counts.tolist(), np.exp(ratio).tolist()))


def _average(levels: np.ndarray) -> float:
    top = levels.max()
    return float(top + math.log2(np.exp2(levels - top).sum()) - math.log2(len(levels)))


def _scorer(profile: list[int], d: int, depths: int | None) -> tuple[Scorer, np.ndarray, np.ndarray]:
    counts, symbols = np.unique([int(m) for m in profile if m > 0], return_counts=True)
    depths = depths or default_depths(d)
    return Scorer(d, depths, _direct(depths)), counts.astype(np.int64), symbols


def log2_q_levels(profile: list[int], d: int, depths: int) -> np.ndarray:
    """log2 q_L of one profile for L = 1..depths."""
    scorer, counts, symbols = _scorer(profile, d, depths)
    return scorer.levels(counts, symbols)


def log2_q(profile: list[int], d: int, depths: int | None = None) -> float:
    """log2 of the average over depths 1..``depths`` (default: ``default_depths(d)``)."""
    scorer, counts, symbols = _scorer(profile, d, depths)
    return scorer.average(counts, symbols)


def depth_posterior(profile: list[int], d: int, depths: int | None = None) -> np.ndarray:
    """Share of each depth in the average."""
    levels = log2_q_levels(profile, d, depths or default_depths(d))
    w = np.exp2(levels - levels.max())
    return w / w.sum()


def predictive(profile: list[int], d: int, depths: int | None = None) -> dict[int, float]:
    """Probability of the next symbol per current count c (0: each unseen one)."""
    scorer, counts, symbols = _scorer(profile, d, depths)
    return scorer.next_symbol(counts, symbols)


#: A state's profile by count classes, largest count first: at most the root of twice its occurrences.
CLASSES = "array<struct<c:bigint,symbols:bigint>>"


def _table_of(profiles: DataFrame, alphabet: int, depths: int | None, profile: str) -> tuple[DataFrame, int, Table]:
    """(the profiles as a written table, depths, moments up to their largest count)."""
    depths = depths or default_depths(alphabet)
    written = cut(profiles, "profiles")
    most = written.agg(F.max(F.col(profile)[0]["c"]).alias("m")).first()["m"] or 1
    return written, depths, moments.build_distributed(profiles.sparkSession, depths, int(most) + 1)


def _per_profile(profiles: DataFrame, alphabet: int, depths: int | None, profile: str, extra: str, each) -> DataFrame:
    written, depths, table = _table_of(profiles, alphabet, depths, profile)
    session = profiles.sparkSession
    sent = session.sparkContext.broadcast((table.columns, table.most))
    kind = [f"{f.name} {f.dataType.simpleString()}" for f in profiles.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(alphabet, depths, Table(*sent.value))
        for b in batches:
            yield each(b, scorer, [(np.array([x["c"] for x in p], np.int64), np.array([x["symbols"] for x in p], np.int64)) for p in b[profile]])

    # A given number of partitions isn't merged afterwards: scoring is costly although its rows are few.
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    return written.repartition(parts, F.xxhash64(profile)).mapInPandas(run, ", ".join(kind) + f", {extra}")


def score_profiles(profiles: DataFrame, alphabet: int, depths: int | None = None, profile: str = "profile") -> DataFrame:
    """Adds ``bits`` = -log2 q to a table of distinct profiles by count classes (``profiles.state_classes``).

    Each row is scored by itself; heavy profiles are spread by their hash first, since states of many visits
    lie together after counting. The table of moments is computed by the cluster, bounded (some 150 columns of
    depth x 421 numbers for counts up to 10^9) and broadcast.
    """
    return _per_profile(profiles, alphabet, depths, profile, "bits double", lambda b, scorer, classes: b.assign(bits=[-scorer.average(*p) for p in classes]))


def next_symbols(profiles: DataFrame, alphabet: int, depths: int | None = None, profile: str = "profile") -> DataFrame:
    """Adds ``next`` = array of (c, p): the probability of the next symbol by its count so far, 0 for each unseen one."""

    def each(b: pd.DataFrame, scorer: Scorer, classes: list) -> pd.DataFrame:
        return b.assign(next=[[{"c": c, "p": p} for c, p in sorted(scorer.next_symbol(*x).items())] for x in classes])

    return _per_profile(profiles, alphabet, depths, profile, "next array<struct<c:bigint,p:double>>", each)


def state_bits(with_profiles: DataFrame, groups: list[str], alphabet: int, depths: int | None = None) -> DataFrame:
    """``groups.., states, n_coded, bits`` of states by the layered mixture: distinct profiles are scored once and joined back."""
    multiset = cut(with_profiles.groupBy(*groups, "profile").agg(F.count("*").alias("states"), F.sum("total").alias("total")), "multiset")
    scored = score_profiles(multiset.select("profile").distinct(), alphabet, depths)
    return multiset.join(scored, "profile").groupBy(*groups).agg(F.sum("states").alias("states"), F.sum("total").alias("n_coded"), F.sum(F.col("states") * F.col("bits")).alias("bits"))
