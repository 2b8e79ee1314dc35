"""Queries on items that appear together (p1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.pair_association import association, exceeds, information, sorted_pair_counts
from tallyflow.sources.tables import cut, read_table

#: A case occurs at least so often, and so many times as often as by chance.
MIN_COUNT, TIMES = 30, 8
CHECKPOINTS = (1, 2, 3, 4)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "sparse_counts").filter((F.col("n") >= 1) & (F.col("k1") != F.col("k2")))
    ends = rows.select("count_id", "run_id", "pair", F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"), "n")
    # The margins and both ends of a pair read the counts again: they are written once.
    return cut(sorted_pair_counts(ends, ["run_id", "pair"], "a", "b", "count_id", "n"), "pairs").withColumnRenamed("n", "c")


def found_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rated = association(_cells(spark, sf), ["run_id", "pair"], MIN_COUNT).filter(exceeds(TIMES))
    return rated.select("run_id", "pair", F.col("a").alias("sym_a"), F.col("b").alias("sym_b"))


def all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Count, factor over chance and log odds ratio of every pair of symbols that stand together."""
    rated = association(_cells(spark, sf), ["run_id", "pair"])
    return rated.select("run_id", "pair", F.col("a").alias("sym_a"), F.col("b").alias("sym_b"), "c", "m_a", "m_b", "t", F.round("factor", 6).alias("factor"), F.round("log_odds", 6).alias("log_odds"))


def run_information(spark: SparkSession, sf: str) -> DataFrame:
    """Mutual information of ``ya`` and ``yb`` per run and checkpoint, with the stated value where one exists.

    ``stated`` is the value of results in bits (nats are converted); ``agrees`` compares to 1e-3 and is
    null where nothing is stated. Of copies of a count that differ the smallest record holds as a whole, of
    repeated results the smallest stated value.
    """
    rows = read_table(spark, sf, "sparse_counts").filter((F.col("n") >= 1) & F.col("pair").isin("ya", "yb") & F.col("count_id").isNotNull())
    one = rows.groupBy("count_id").agg(F.min(F.struct("run_id", "checkpoint", "pair", "k1", "k2", "n")).alias("r")).select("r.*")
    mi = information(one.select("run_id", "pair", F.col("checkpoint").alias("step"), "k1", "k2", "n"), ["run_id", "pair"], list(CHECKPOINTS))
    scale = F.when(F.col("mi_unit") == "nats", 1 / F.log(F.lit(2.0))).when(F.col("mi_unit") == "bits", 1.0)
    stated = read_table(spark, sf, "results").select("run_id", F.col("checkpoint").alias("step"), F.explode(F.array(F.struct(F.lit("ya").alias("pair"), (F.col("mi_lag1") * scale).alias("v")), F.struct(F.lit("yb").alias("pair"), (F.col("mi_lag2") * scale).alias("v")))).alias("s")).select("run_id", "step", "s.*")
    stated = stated.groupBy("run_id", "step", "pair").agg(F.min("v").alias("v"))
    out = mi.join(stated, ["run_id", "step", "pair"], "left")
    return out.select("run_id", "pair", F.col("step").alias("checkpoint"), "n", F.round("mi", 6).alias("mi"), F.round("v", 4).alias("stated"), (F.abs(F.col("mi") - F.col("v")) < 1e-3).alias("agrees"))


QUERIES = {"p1_found": found_pairs, "p1_pairs": all_pairs, "p1_information": run_information}

_RATED = """WITH d AS (SELECT DISTINCT count_id, run_id, pair, k1, k2, n FROM sparse_counts WHERE n >= 1 AND k1 <> k2 AND count_id IS NOT NULL AND run_id IS NOT NULL AND pair IS NOT NULL),
 c AS (SELECT run_id, pair, least(k1, k2) AS a, greatest(k1, k2) AS b, CAST(sum(n) AS BIGINT) AS c FROM d GROUP BY ALL),
 m AS (SELECT run_id, pair, x, CAST(sum(c) AS BIGINT) AS m FROM (SELECT run_id, pair, a AS x, c FROM c UNION ALL SELECT run_id, pair, b, c FROM c) GROUP BY ALL),
 t AS (SELECT run_id, pair, CAST(sum(c) AS BIGINT) AS t FROM c GROUP BY ALL),
 r AS (SELECT c.run_id, c.pair, c.a, c.b, c.c, ma.m AS m_a, mb.m AS m_b, t.t FROM c JOIN m ma ON ma.run_id = c.run_id AND ma.pair = c.pair AND ma.x = c.a
  JOIN m mb ON mb.run_id = c.run_id AND mb.pair = c.pair AND mb.x = c.b JOIN t ON t.run_id = c.run_id AND t.pair = c.pair)"""

ORACLE = {
    "p1_found": f"{_RATED} SELECT run_id, pair, a AS sym_a, b AS sym_b FROM r WHERE c >= 30 AND 2 * CAST(t AS HUGEINT) * c >= 8 * CAST(m_a AS HUGEINT) * m_b",
    "p1_pairs": f"""{_RATED} SELECT run_id, pair, a AS sym_a, b AS sym_b, c, m_a, m_b, t, round(2.0 * t * c / (CAST(m_a AS DOUBLE) * m_b), 6) AS factor,
 round(ln(c + 0.5) + ln(t - m_a - m_b + c + 0.5) - ln(m_a - c + 0.5) - ln(m_b - c + 0.5), 6) AS log_odds FROM r""",
    "p1_information": """WITH d AS (SELECT DISTINCT count_id, run_id, checkpoint, pair, k1, k2, n FROM sparse_counts WHERE n >= 1 AND pair IN ('ya', 'yb') AND count_id IS NOT NULL),
 u AS (SELECT s AS checkpoint, run_id, pair, k1, k2, sum(n) AS n FROM d JOIN (SELECT unnest([1, 2, 3, 4]) AS s) ON checkpoint <= s GROUP BY ALL),
 r AS (SELECT checkpoint, run_id, pair, k1, sum(n) AS r FROM u GROUP BY ALL), l AS (SELECT checkpoint, run_id, pair, k2, sum(n) AS l FROM u GROUP BY ALL),
 t AS (SELECT checkpoint, run_id, pair, sum(n) AS t FROM u GROUP BY ALL),
 i AS (SELECT u.run_id, u.pair, u.checkpoint, CAST(max(t) AS BIGINT) AS n, greatest(0.0, sum(CAST(n AS DOUBLE) / t * log2(CAST(n AS DOUBLE) * t / (CAST(r AS DOUBLE) * l)))) AS mi
  FROM u JOIN r USING (checkpoint, run_id, pair, k1) JOIN l USING (checkpoint, run_id, pair, k2) JOIN t USING (checkpoint, run_id, pair) GROUP BY ALL),
 s AS (SELECT run_id, checkpoint, pair, min(v) AS v FROM (SELECT run_id, checkpoint, 'ya' AS pair, mi_lag1 * CASE mi_unit WHEN 'nats' THEN 1 / ln(2.0) WHEN 'bits' THEN 1 END AS v FROM results
  UNION ALL SELECT run_id, checkpoint, 'yb', mi_lag2 * CASE mi_unit WHEN 'nats' THEN 1 / ln(2.0) WHEN 'bits' THEN 1 END FROM results) GROUP BY ALL)
 SELECT i.run_id, i.pair, i.checkpoint, n, round(mi, 6) AS mi, round(v, 4) AS stated, abs(mi - v) < 1e-3 AS agrees FROM i LEFT JOIN s ON s.run_id = i.run_id AND s.pair = i.pair AND s.checkpoint = i.checkpoint""",
}
