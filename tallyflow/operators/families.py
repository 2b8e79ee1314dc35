"""Families of models over one count table: resolutions of the state, products of two lags, single lags.

All members of a family are derived from the same capped counts by exploding a small declared grid, then
two aggregations: per (member, state), then per member. ``n_coded`` is the positions every member codes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import layered
from tallyflow.functions.special import add_one_state_bits, kt_state_bits
from tallyflow.operators import profiles

LEAVES = {"kt": kt_state_bits, "add_one": add_one_state_bits}


def _grid(values: list[tuple], names: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in values])).alias("g")


def member_counts(counts: DataFrame, grid: list[tuple], names: list[str], states: dict[str, Column]) -> DataFrame:
    """``names.., states.., y, n`` of every member: states are columns over ``g`` (the member) and the counts."""
    each = counts.select("*", _grid(grid, names)).select(*[F.col(f"g.{n}").alias(n) for n in names], *[c.alias(s) for s, c in states.items()], "y", "n")
    return each.groupBy(*names, *states, "y").agg(F.sum("n").alias("n"))


def member_bits(members: DataFrame, names: list[str], states: list[str], alphabet: int, leaf: str = "kt") -> DataFrame:
    """``names.., states, n_coded, bits``: the codelength of each member, a product over its states."""
    per_state = members.groupBy(*names, *states).agg(F.sum("n").alias("n"), LEAVES[leaf]("n", alphabet).alias("bits"))
    return per_state.groupBy(*names).agg(F.count("*").alias("states"), F.sum("n").alias("n_coded"), F.sum("bits").alias("bits"))


def layered_bits(members: DataFrame, names: list[str], states: list[str], alphabet: int, depths: int | None = None) -> DataFrame:
    """The same as ``member_bits`` with the layered mixture at the leaves: each distinct profile of all members is scored once."""
    return layered.state_bits(profiles.state_classes(members, [*names, *states]), names, alphabet, depths)


def state_members(pairs: DataFrame, grid: list[int], x: str = "x1") -> DataFrame:
    """Members {M}: the M leading symbols are states of their own, the others share state M; M = 0 is memoryless."""
    return member_counts(pairs, [(m,) for m in grid], ["m"], {"state": F.least(F.col(x), F.col("g.m"))})


def product_members(triples: DataFrame, grid: list[tuple[int, int]]) -> DataFrame:
    """Members (M1, M2): two lags at two resolutions; (M, 0) is first order over the same positions.

    Positions without a second lag belong in the triples with the unknown symbol there (``backoff``), so that
    (M, 0) is first order over all positions that have a predecessor.
    """
    if any(b > a for a, b in grid):
        raise ValueError("M2 may not exceed M1")
    return member_counts(triples, grid, ["m1", "m2"], {"s1": F.least(F.col("x1"), F.col("g.m1")), "s2": F.least(F.col("x2"), F.col("g.m2"))})


def mixture(members: DataFrame, names: list[str]) -> DataFrame:
    """``names.., bits, posterior, family_bits, best``: uniform mixture over the members of a family.

    Members are a declared grid, so a window over all of them is a few rows.
    """
    from pyspark.sql import Window as W

    everything = W.partitionBy()
    least = F.min("bits").over(everything)
    weight = F.pow(F.lit(2.0), least - F.col("bits"))
    with_sum = members.withColumn("_w", weight).withColumn("_least", least).withColumn("_s", F.sum("_w").over(everything)).withColumn("_k", F.count("*").over(everything))
    family = F.col("_least") - F.log("_s") / math.log(2) + F.log(F.col("_k").cast("double")) / math.log(2)
    return with_sum.select(*members.columns, (F.col("_w") / F.col("_s")).alias("posterior"), family.alias("family_bits"), (F.col("bits") == F.col("_least")).alias("best"))


def two_part_bits(members: DataFrame, names: list[str], description: Column) -> DataFrame:
    """The mixture with each member's description bits added to its data bits."""
    return mixture(members.withColumn("bits", F.col("bits") + description), names)


def bits_per_character(bits: Column, n_bytes: Column, fixed_bits: Column | float = 0.0) -> Column:
    """(bits + fixed bits) / bytes of the original."""
    return (bits + (F.lit(fixed_bits) if isinstance(fixed_bits, (int, float)) else fixed_bits)) / n_bytes
