"""Mathematical columns that Spark SQL lacks, as native expressions inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2.0)


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, brought back by the recurrence (error below 4e-12)."""
    x = x.cast("double")
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12.0 * y) - 1 / (360.0 * y * y * y) + 1 / (1260.0 * F.pow(y, F.lit(5.0))) - 1 / (1680.0 * F.pow(y, F.lit(7.0)))
    product = x
    for k in range(1, 8):
        product = product * (x + float(k))
    return series - F.log(product)


def log2(x: Column) -> Column:
    return F.log(x) / LN2


def xlog2x(x: Column) -> Column:
    """x log2 x, 0 at 0: sums of it over counts give every entropy without joining totals."""
    x = x.cast("double")
    return F.when(x > 0, x * F.log(x) / LN2).otherwise(0.0)


def log2_choose(n: int, k: int) -> float:
    """log2 of the number of k-subsets of n."""
    return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / LN2


def kt_state_bits(c: str, alphabet: int) -> Column:
    """Aggregate: bits of one state's final counts ``c`` by the KT rule over ``alphabet`` symbols.

    -log2 [ Gamma(V/2) / Gamma(n + V/2) * prod Gamma(m + 1/2) / Gamma(1/2) ].
    """
    half = math.lgamma(alphabet / 2)
    n = F.sum(c)
    return (lgamma(n + alphabet / 2.0) - half - F.sum(lgamma(F.col(c) + 0.5) - math.lgamma(0.5))) / LN2


def add_one_state_bits(c: str, alphabet: int) -> Column:
    """Aggregate: bits of one state by the add-one rule (depth 1 of the layered mixture)."""
    n = F.sum(c)
    return (lgamma(n + float(alphabet)) - math.lgamma(alphabet) - F.sum(lgamma(F.col(c) + 1.0))) / LN2
