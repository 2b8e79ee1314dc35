"""Context-tree weighting over counted contexts.

beta(node) = 1/2 q(node) + 1/2 product of beta(children), q at the leaves of depth D, in the log2 domain.
Depth is small (2 to 4), so the recursion is a driver loop over lazy aggregations: each level sends its
nodes' values to their parents. Children without observations contribute nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions import layered
from tallyflow.operators import profiles
from tallyflow.operators.families import LEAVES
from tallyflow.sources.tables import cut


def node_bits(nodes: DataFrame, depth: int, alphabet: int, leaf: str = "kt") -> DataFrame:
    """``d, x1.., n, q``: log2 of the leaf law of each node of ``counting.context_nodes``."""
    names = [f"x{i}" for i in range(1, depth + 1)]
    return nodes.groupBy("d", *names).agg(F.sum("n").alias("n"), (-LEAVES[leaf]("n", alphabet)).alias("q"))


def layered_node_bits(nodes: DataFrame, depth: int, alphabet: int, depths: int | None = None) -> DataFrame:
    """The same with the layered mixture as leaf law; nodes of equal profiles are scored once."""
    names = [f"x{i}" for i in range(1, depth + 1)]
    states = cut(profiles.state_classes(nodes, ["d", *names]), "nodes")
    scored = layered.score_profiles(states.select("profile").distinct(), alphabet, depths)
    return cut(states.join(scored, "profile").select("d", *names, F.col("total").alias("n"), (-F.col("bits")).alias("q")), "scored")


def _half_sum(a, b):
    """log2(2**a / 2 + 2**b / 2)."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return hi + F.log(F.lit(1.0) + F.pow(F.lit(2.0), lo - hi)) / math.log(2) - 1.0


def weigh(scored: DataFrame, depth: int) -> DataFrame:
    """Per node ``d, x1.., n, q, beta, gamma, split``: mixture, best pruning, and whether that splits here.

    gamma(node) = max(q - 1, product of gamma(children) - 1), q at depth D; a node is split only if that
    is strictly better.
    """
    names = [f"x{i}" for i in range(1, depth + 1)]
    level = scored.filter(F.col("d") == depth).select("d", *names, "n", "q", F.col("q").alias("beta"), F.col("q").alias("gamma"), F.lit(False).alias("split"))
    out = level
    for d in range(depth - 1, -1, -1):
        keys = names[:d]
        sums = level.groupBy(*keys).agg(F.sum("beta").alias("kids"), F.sum("gamma").alias("kid_gamma"))
        here = scored.filter(F.col("d") == d)
        # The root has no key: its one row meets the one row of sums.
        joined = here.join(sums, keys) if keys else here.withColumn("kids", sums.select("kids").scalar()).withColumn("kid_gamma", sums.select("kid_gamma").scalar())
        level = joined.select("d", *names, "n", "q", _half_sum(F.col("q"), F.col("kids")).alias("beta"), (F.greatest("q", "kid_gamma") - 1.0).alias("gamma"), (F.col("kid_gamma") > F.col("q")).alias("split"))
        out = out.unionByName(level)
    return out


def tree_summary(weighed: DataFrame) -> DataFrame:
    """``n_coded, tree_bits, map_bits``: codelengths of the mixture and of the best pruning."""
    return weighed.filter("d = 0").select(F.col("n").alias("n_coded"), (-F.col("beta")).alias("tree_bits"), (-F.col("gamma")).alias("map_bits"))


def fixed_depths(scored: DataFrame) -> DataFrame:
    """``d, nodes, n_coded, bits``: all contexts of one length, each coded by its leaf law."""
    return scored.groupBy("d").agg(F.count("*").alias("nodes"), F.sum("n").alias("n_coded"), (-F.sum("q")).alias("bits"))


def map_leaves(weighed: DataFrame, depth: int) -> DataFrame:
    """``d, leaves, n``: the leaves of the best pruning by depth; a node is reached if all above it split."""
    names = [f"x{i}" for i in range(1, depth + 1)]
    reached = weighed.filter("d = 0")
    leaves = []
    for d in range(depth + 1):
        leaves.append(reached.filter(~F.col("split")).select("d", "n"))
        if d < depth:
            parents = reached.filter("split").select(*names[:d])
            below = weighed.filter(F.col("d") == d + 1)
            reached = below.join(parents, names[:d], "left_semi") if d else below.withColumn("_any", parents.agg(F.count("*")).scalar()).filter("_any > 0").drop("_any")
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out.groupBy("d").agg(F.count("*").alias("leaves"), F.sum("n").alias("n"))
