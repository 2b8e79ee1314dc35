"""Entropies, plug-in losses and redundancy reports from count tables.

Everything is a sum of x log2 x over cells or margins, so totals are never joined to cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.special import LN2, log2, xlog2x

#: Upper edges of the visit buckets of the redundancy report (fixed values).
BUCKET_EDGES = (1, 2, 5, 10, 30, 100, 300, 1000, 10_000, 100_000, 1_000_000_000)


def _f(c: str):
    return F.sum(xlog2x(F.col(c)))


def entropy(counts: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """``groups.., n, types, bits``: plug-in entropy of the counts of each group."""
    n = F.sum("n")
    return counts.groupBy(*(groups or [])).agg(n.alias("n"), F.count("*").alias("types"), (log2(n.cast("double")) - _f("n") / n).alias("bits"))


def conditional_entropy(pairs: DataFrame, state: str, groups: list[str] | None = None) -> DataFrame:
    """``groups.., n, pairs, states, bits``: H(y | state) = (sum f(state) - sum f(cell)) / n with f = x log2 x."""
    groups = groups or []
    per_state = pairs.groupBy(*groups, state).agg(F.sum("n").alias("n"), _f("n").alias("cells"), F.count("*").alias("pairs"))
    n = F.sum("n")
    return per_state.groupBy(*groups).agg(n.alias("n"), F.sum("pairs").alias("pairs"), F.count("*").alias("states"), ((_f("n") - F.sum("cells")) / n).alias("bits"))


def state_report(pairs: DataFrame, state: str) -> DataFrame:
    """Per state: tokens, support, plug-in bits and the Miller-Madow term (support - 1) / (2 ln 2)."""
    n = F.sum("n")
    plugin = xlog2x(n) - _f("n")
    return pairs.groupBy(state).agg(n.alias("tokens"), F.count("*").alias("support"), plugin.alias("plugin_bits"), ((F.count("*") - 1) / (2 * LN2)).alias("miller_madow_bits"))


def visit_bucket(tokens):
    """(lower, upper] bucket of a number of visits as its upper edge."""
    out = F.lit(BUCKET_EDGES[-1])
    for e in reversed(BUCKET_EDGES[:-1]):
        out = F.when(tokens <= e, e).otherwise(out)
    return out.cast("bigint")


def redundancy_buckets(states: DataFrame, model_bits: str = "model_bits") -> DataFrame:
    """``upto, states, tokens, model_bits, plugin_bits, miller_madow_bits, excess_bits`` by visits of the state."""
    by = states.groupBy(visit_bucket(F.col("tokens")).alias("upto"))
    return by.agg(
        F.count("*").alias("states"), F.sum("tokens").alias("tokens"), F.sum(model_bits).alias("model_bits"), F.sum("plugin_bits").alias("plugin_bits"),
        F.sum("miller_madow_bits").alias("miller_madow_bits"), (F.sum(model_bits) - F.sum("plugin_bits") - F.sum("miller_madow_bits")).alias("excess_bits"),
    )


def mutual_information(joint: DataFrame, a: str, b: str) -> DataFrame:
    """``n, bits``: I(a; b) of the counts, from three independent sums."""
    cell = joint.groupBy(a, b).agg(F.sum("n").alias("n"))
    whole = cell.agg(F.sum("n").alias("n"), _f("n").alias("f"))
    rows = cell.groupBy(a).agg(F.sum("n").alias("n")).agg((-_f("n")).alias("f"), F.lit(0).cast("bigint").alias("n"))
    cols = cell.groupBy(b).agg(F.sum("n").alias("n")).agg((-_f("n")).alias("f"), F.lit(0).cast("bigint").alias("n"))
    all_three = whole.unionByName(rows).unionByName(cols)
    return all_three.agg(F.sum("n").alias("n"), F.sum("f").alias("f")).select("n", F.greatest(F.lit(0.0), log2(F.col("n").cast("double")) + F.col("f") / F.col("n")).alias("bits"))


def grain_curve(pairs: DataFrame, grid: list[int], rank: str = "x") -> DataFrame:
    """``m, n, pairs, states, bits``: H(y | state) with the states of rank m and beyond in one, for each m of the grid."""
    each = pairs.select(F.explode(F.array(*map(F.lit, grid))).alias("m"), "y", F.col(rank).alias("r"), "n").select("m", F.least("r", "m").alias("state"), "y", "n")
    return conditional_entropy(each.groupBy("m", "state", "y").agg(F.sum("n").alias("n")), "state", ["m"])


def mass_quantiles(counts: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """``share, ranks``: how many of the leading symbols hold each share of all occurrences.

    ``counts`` has a row ``n`` for each symbol of the whole vocabulary. Ranks run over the histogram count ->
    number of symbols: of t occurrences in all there are at most sqrt(2 t) different counts, so one task orders
    them. Within a count the rank is the least one that reaches the share. No counts: no rows.
    """
    from pyspark.sql import Window as W

    classes = counts.groupBy("n").agg(F.count("*").alias("symbols"))
    down = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, 0)
    mass = F.col("n") * F.col("symbols")
    every = W.orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    running = classes.select("n", (F.sum("symbols").over(down) - F.col("symbols")).alias("before"), F.sum(mass).over(down).alias("upto"), (F.sum(mass).over(down) - mass).alias("start"), F.sum(mass).over(every).alias("total"))
    wanted = running.select(F.explode(F.array(*map(F.lit, shares))).alias("share"), "*").withColumn("need", F.col("share") * F.col("total"))
    reached = wanted.filter("upto >= need")
    return reached.groupBy("share").agg(F.min(F.col("before") + F.greatest(F.lit(1), F.ceil((F.col("need") - F.col("start")) / F.col("n")))).cast("int").alias("ranks"))


def conditional_log_loss(pairs: DataFrame, joint_probability, state: str) -> DataFrame:
    """``bits``: loss per pair of the conditional law that a joint plug-in probability implies.

    ``joint_probability`` turns a pair's count into its probability; a state's law is that divided by
    the sum over its observed pairs. Two levels: per (state, count) how many symbols, then per state.
    """
    classes = pairs.groupBy(state, F.col("n").alias("c")).agg(F.count("*").alias("k")).withColumn("q", joint_probability(F.col("c")))
    per = classes.groupBy(state).agg(F.sum(F.col("c") * F.col("k")).alias("n"), F.sum(F.col("k") * F.col("q")).alias("mass"), F.sum(F.col("c") * F.col("k") * log2(F.col("q"))).alias("l"))
    return per.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * log2(F.col("mass")) - F.col("l")) / F.sum("n")).alias("bits"))


def marginal_bound(pairs: DataFrame, state: str, per_state_bits: DataFrame) -> DataFrame:
    """``states, model_bits, bound_bits, better``: coding a state by the marginal law of y where that is shorter.

    Per state min(model, sum c log2(1/m_y)) + 1 bit for the choice; m_y is the share of y over all states.
    """
    y = pairs.groupBy("y").agg(F.sum("n").alias("y_n"))
    whole = y.agg(F.sum("y_n").alias("w"))
    priced = y.withColumn("w", whole.scalar()).select("y", log2(F.col("w") / F.col("y_n")).alias("price"))
    cost = pairs.join(priced, "y").groupBy(state).agg(F.sum(F.col("n") * F.col("price")).alias("marginal_bits"))
    both = cost.join(per_state_bits, state)
    least = F.least("marginal_bits", "model_bits")
    return both.agg(F.count("*").alias("states"), F.sum("model_bits").alias("model_bits"), F.sum(least + 1).alias("bound_bits"), F.count_if(F.col("marginal_bits") < F.col("model_bits")).alias("better"))


def subset_bits(n: int, k: int) -> float:
    """Bits to say which k of n symbols are kept."""
    return (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / LN2
