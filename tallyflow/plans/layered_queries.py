"""Queries on the layered mixture: families, trees and predictive laws, at alphabets of 65 and 1,025 symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions import layered
from tallyflow.functions.special import kt_state_bits
from tallyflow.operators import context_tree, counting, families, profiles, vocabulary
from tallyflow.plans.model_queries import LAGS, PRODUCT_GRID, _rounded
from tallyflow.plans.shared import GRID, K, V, capped_pairs, capped_triples, capped_triples_backoff, tokens, vocab
from tallyflow.sources.tables import cut, read_table

#: A larger alphabet, and the numbers of states kept from it.
K_LARGE = 1024
GRID_LARGE = [0, 64, 256, 1024]


def _family(members: DataFrame, names: list[str], states: list[str], alphabet: int) -> DataFrame:
    return _rounded(families.mixture(families.layered_bits(members, names, states, alphabet), names), "bits", "posterior", "family_bits", digits=3)


def _large_pairs(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.capped(counting.context_counts(tokens(s, d), [1]), vocab(s, d, K_LARGE), ["y", "x1"], K_LARGE)


def _lag_counts(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.capped(counting.lag_counts(tokens(s, d), LAGS), vocab(s, d), ["y", "x"], K)


def _first_order(s: SparkSession, d: str) -> DataFrame:
    """Layered mixture bits of a first-order code, beside KT."""
    pairs = cut(capped_pairs(s, d), "pairs")
    bits = layered.state_bits(profiles.state_classes(pairs, ["x1"]), [], V)
    kts = pairs.groupBy("x1").agg(kt_state_bits("n", V).alias("b")).agg(F.sum("b").alias("b"))
    return _rounded(bits.withColumn("kt_bits", kts.scalar()), "bits", "kt_bits", digits=3)


def _predictive(s: SparkSession, d: str) -> DataFrame:
    """``x1, c, p``: probability of the next symbol by its count so far, for the states' count classes."""
    states = profiles.state_classes(capped_pairs(s, d), ["x1"]).select("x1", "profile")
    return layered.next_symbols(states, V).select("x1", F.inline("next")).select("x1", "c", F.round("p", 9).alias("p"))


def _loss(s: SparkSession, d: str) -> DataFrame:
    """Loss of the conditional law that the pairs' joint layered law implies: class probabilities of the whole pair profile."""
    pairs = cut(capped_pairs(s, d), "pairs")
    whole = profiles.state_classes(pairs, []).select("profile")
    law = layered.next_symbols(whole, V * V).select(F.inline("next")).select(F.col("c").alias("n"), "p")
    priced = pairs.join(F.broadcast(law), "n")
    per = priced.groupBy("x1").agg(F.sum("n").alias("n"), F.sum("p").alias("mass"), F.sum(F.col("n") * F.log2("p")).alias("l"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.log2("mass") - F.col("l")) / F.sum("n"), 6).alias("bits"))


def _tree(counts: DataFrame, depth: int, alphabet: int) -> DataFrame:
    scored = context_tree.layered_node_bits(counting.context_nodes(counts, depth), depth, alphabet)
    return _rounded(context_tree.tree_summary(context_tree.weigh(scored, depth)), "tree_bits", "map_bits", digits=3)


def _quadruples(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.capped(counting.context_counts(tokens(s, d), [1, 2, 3]), vocab(s, d), ["y", "x1", "x2", "x3"], K)


def _nations(s: SparkSession, d: str) -> DataFrame:
    """``region, n, bits1, bits2, bits3``: customers of a region by nation, coded over all nations, at depths 1 to 3."""
    each = read_table(s, d, "customer").join(F.broadcast(read_table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region"), "n_nationkey").agg(F.count("*").alias("n"))
    states = profiles.state_classes(each, ["region"])
    out = states.select("region", F.col("total").alias("n"))
    for depth in (1, 2, 3):
        bits = layered.score_profiles(states.select("region", "profile"), 25, depth).select("region", F.round("bits", 4).alias(f"bits{depth}"))
        out = out.join(bits, "region")
    return out


QUERIES = {
    "layered_first_order": _first_order,
    "layered_predictive": _predictive,
    "layered_pair_loss": _loss,
    "layered_state_family": lambda s, d: _family(families.state_members(capped_pairs(s, d), GRID), ["m"], ["state"], V),
    "layered_product_family": lambda s, d: _family(families.product_members(capped_triples_backoff(s, d), PRODUCT_GRID), ["m1", "m2"], ["s1", "s2"], V),
    "layered_lag_family": lambda s, d: _family(_lag_counts(s, d), ["lag"], ["x"], V),
    "layered_tree": lambda s, d: _tree(capped_triples(s, d), 2, V),
    "layered_tree_d3": lambda s, d: _tree(_quadruples(s, d), 3, V),
    "layered_state_family_1024": lambda s, d: _family(families.state_members(_large_pairs(s, d), GRID_LARGE), ["m"], ["state"], K_LARGE + 1),
    "layered_nations": _nations,
}

# phi of layers 1 to 3 over Gamma(r + 1)^l on a grid of u (step 0.06) by plain sums over v, and the integral over u.
_PHI = """k AS MATERIALIZED (SELECT n_regionkey AS region, n_nationkey, count(*) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
 rs AS (SELECT DISTINCT m AS r FROM k UNION SELECT 0), vs AS (SELECT unnest(range(-600, 165)) AS j), kr AS MATERIALIZED (SELECT r, j, (r + 1) * j * 0.06 - exp(j * 0.06) - lgamma(r + 1) AS e FROM rs, vs WHERE r < 20 OR j > -130),
 p1 AS (SELECT r, i, -(r + 1) * ln(1 + exp(i * 0.06)) AS f FROM rs, (SELECT unnest(range(-1900, 850)) AS i)),
 t2 AS MATERIALIZED (SELECT kr.r, i, e - (kr.r + 1) * ln(1 + exp((i + j) * 0.06)) AS x FROM kr, (SELECT unnest(range(-1250, 670)) AS i)),
 p2 AS MATERIALIZED (SELECT r, i, m + ln(sum(0.06 * exp(x - m))) AS f FROM t2 JOIN (SELECT r, i, max(x) AS m FROM t2 GROUP BY r, i) USING (r, i) GROUP BY r, i, m),
 t3 AS MATERIALIZED (SELECT kr.r, g.i, e + p2.f AS x FROM kr CROSS JOIN (SELECT unnest(range(-640, 470)) AS i) g JOIN p2 ON p2.r = kr.r AND p2.i = g.i + kr.j),
 p3 AS MATERIALIZED (SELECT r, i, m + ln(sum(0.06 * exp(x - m))) AS f FROM t3 JOIN (SELECT r, i, max(x) AS m FROM t3 GROUP BY r, i) USING (r, i) GROUP BY r, i, m),
 s AS (SELECT region, sum(m) AS n, count(*) AS c FROM k GROUP BY region),
 pl AS (SELECT 1 AS l, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3),
 g AS (SELECT k.region, l, i, sum(f + l * lgamma(m + 1)) AS f FROM k JOIN pl ON pl.r = k.m GROUP BY ALL),
 w AS (SELECT g.region, g.l, g.f + (25 - c) * z.f + n * g.i * 0.06 - lgamma(n) AS e, n FROM g JOIN s USING (region) JOIN pl z ON z.l = g.l AND z.i = g.i AND z.r = 0 WHERE g.i BETWEEN -600 AND 300),
 q AS (SELECT region, l, any_value(n) AS n, max(m) + ln(sum(0.06 * exp(e - m))) AS q FROM (SELECT *, max(e) OVER (PARTITION BY region, l) AS m FROM w) GROUP BY region, l)"""

ORACLE = {
    "layered_nations": f"WITH {_PHI}, a2 AS (SELECT region, n, l, (mq + ln(sum(exp(q - mq)) OVER (PARTITION BY region ORDER BY l)) - ln(l)) AS a FROM (SELECT *, max(q) OVER (PARTITION BY region) AS mq FROM q)) SELECT region, CAST(max(n) AS BIGINT) AS n, round(max(CASE WHEN l = 1 THEN -a / ln(2.0) END), 4) AS bits1, round(max(CASE WHEN l = 2 THEN -a / ln(2.0) END), 4) AS bits2, round(max(CASE WHEN l = 3 THEN -a / ln(2.0) END), 4) AS bits3 FROM a2 GROUP BY region",
}
