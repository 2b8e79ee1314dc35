"""Reports over checkpoints: what each block adds, how it is coded by what came before, and at what regret.

Inputs are block counts ``checkpoint, y, x1, n`` (``counting.interval_counts``, capped); counts before a block
are sums of earlier blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.special import kt_state_bits, log2
from tallyflow.operators import counting, profiles
from tallyflow.operators.pair_models import edge_births


def new_edges(blocks: DataFrame, a: str, b: str) -> DataFrame:
    """``checkpoint, edges, upto``: pairs that occur for the first time in each block, and all so far."""
    from pyspark.sql import Window as W

    each = edge_births(blocks, a, b).groupBy(F.col("birth").alias("checkpoint")).agg(F.count("*").alias("edges"))
    # One row per checkpoint.
    return each.withColumn("upto", F.sum("edges").over(W.orderBy("checkpoint").rowsBetween(W.unboundedPreceding, 0)))


def missing_keys(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of an earlier table that a later one lacks; supports only grow, so there should be none."""
    return before.select(*keys).join(now.select(*keys), keys, "left_anti")


def frozen_costs(blocks: DataFrame, last: int, alphabet: int) -> DataFrame:
    """``checkpoint, y, x1, n, seen, cost``: each block's cells coded by the KT law of all blocks before it.

    ``seen`` tells whether the cell occurred before; ``cost`` is in bits for all n occurrences.
    """
    upto = counting.cumulative_counts(blocks, ["y", "x1"], list(range(1, last + 1)))
    before = upto.select((F.col("checkpoint") + 1).alias("checkpoint"), "y", "x1", F.col("n").alias("c"))
    totals = before.groupBy("checkpoint", "x1").agg(F.sum("c").alias("t"))
    joined = blocks.join(before, ["checkpoint", "y", "x1"], "left").join(totals, ["checkpoint", "x1"], "left")
    cost = F.col("n") * log2((F.coalesce("t", F.lit(0)) + alphabet / 2.0) / (F.coalesce("c", F.lit(0)) + 0.5))
    return joined.select("checkpoint", "y", "x1", "n", F.col("c").isNotNull().alias("seen"), cost.alias("cost"))


def interval_scores(costs: DataFrame) -> DataFrame:
    """``checkpoint, scored, supported, bits``: tokens of each block, the share in cells seen before, frozen bits."""
    return costs.groupBy("checkpoint").agg(F.sum("n").alias("scored"), (F.sum(F.when(F.col("seen"), F.col("n")).otherwise(0)) / F.sum("n")).alias("supported"), F.sum("cost").alias("bits"))


def prefix_bits(blocks: DataFrame, last: int, alphabet: int) -> DataFrame:
    """``checkpoint, bits``: exact first-order KT codelength of everything up to each checkpoint."""
    upto = counting.cumulative_counts(blocks, ["y", "x1"], list(range(1, last + 1)))
    return upto.groupBy("checkpoint", "x1").agg(kt_state_bits("n", alphabet).alias("b")).groupBy("checkpoint").agg(F.sum("b").alias("bits"))


def regret(blocks: DataFrame, last: int, alphabet: int) -> DataFrame:
    """``checkpoint, frozen_bits, exact_bits, regret``: frozen cost of a block less the growth of the exact code."""
    exact = prefix_bits(blocks, last, alphabet)
    earlier = exact.select((F.col("checkpoint") + 1).alias("checkpoint"), F.col("bits").alias("was"))
    growth = exact.join(earlier, "checkpoint", "left").select("checkpoint", (F.col("bits") - F.coalesce("was", F.lit(0.0))).alias("exact_bits"))
    frozen = interval_scores(frozen_costs(blocks, last, alphabet)).select("checkpoint", F.col("bits").alias("frozen_bits"))
    return frozen.join(growth, "checkpoint").withColumn("regret", F.col("frozen_bits") - F.col("exact_bits"))


def prefix_profiles(blocks: DataFrame, last: int) -> DataFrame:
    """``checkpoint, profile, states``: the profiles of all states at each checkpoint, with multiplicities."""
    upto = counting.cumulative_counts(blocks, ["y", "x1"], list(range(1, last + 1)))
    return profiles.profile_multiset(profiles.state_profiles(upto, ["checkpoint", "x1"]), ["checkpoint"])


def window_rings(costs: DataFrame, windows: list[int]) -> DataFrame:
    """``stop, tokens, bits, ring_tokens, ring_bits``: growing windows after an anchor and the rings between them.

    costs: ``checkpoint, n, cost`` in which checkpoint k + 1 is the k-th ring, all coded by the law at the anchor.
    """
    from pyspark.sql import Window as W

    ring = costs.groupBy("checkpoint").agg(F.sum("n").alias("ring_tokens"), F.sum("cost").alias("ring_bits"))
    grow = W.orderBy("checkpoint").rowsBetween(W.unboundedPreceding, 0)
    stop = F.element_at(F.array(*map(F.lit, windows)), F.col("checkpoint") - 1)
    return ring.select(stop.alias("stop"), F.sum("ring_tokens").over(grow).alias("tokens"), F.sum("ring_bits").over(grow).alias("bits"), "ring_tokens", "ring_bits")


def anchored_costs(blocks: DataFrame, alphabet: int) -> DataFrame:
    """``checkpoint, n, cost`` of blocks 2, 3, .. all coded by the KT law of block 1 (the anchor's prefix)."""
    anchor = blocks.filter("checkpoint = 1").select("y", "x1", F.col("n").alias("c"))
    totals = anchor.groupBy("x1").agg(F.sum("c").alias("t"))
    later = blocks.filter("checkpoint > 1").join(anchor, ["y", "x1"], "left").join(totals, "x1", "left")
    cost = F.col("n") * log2((F.coalesce("t", F.lit(0)) + alphabet / 2.0) / (F.coalesce("c", F.lit(0)) + 0.5))
    return later.select("checkpoint", "n", cost.alias("cost"))
