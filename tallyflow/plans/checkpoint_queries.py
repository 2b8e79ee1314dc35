"""Queries on what blocks of positions add to counts, codes and supports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators import checkpoints, pooled, profiles
from tallyflow.plans.model_queries import _rounded
from tallyflow.plans.pair_queries import _SMALL, SMALL, SMALL_V, _small_vocab
from tallyflow.plans.shared import kt, tokens
from tallyflow.sources.tables import cut

EDGES = [2, 32, 128, 512, None]
LAST = len(EDGES) - 1
WINDOWS = [16, 64, 256, 1024]
ANCHOR = 64


def _blocks(s: SparkSession, d: str, edges: list[int | None] = EDGES) -> DataFrame:
    return cut(pooled.block_cells(tokens(s, d), _small_vocab(s, d), SMALL, [1], edges), "blocks")


def _rings(s: SparkSession, d: str) -> DataFrame:
    blocks = _blocks(s, d, [1, ANCHOR, *[ANCHOR + w for w in WINDOWS]])
    return _rounded(checkpoints.window_rings(checkpoints.anchored_costs(blocks, SMALL_V), WINDOWS), "bits", "ring_bits")


QUERIES = {
    "graph_deltas": lambda s, d: checkpoints.new_edges(_blocks(s, d), "y", "x1"),
    "interval_scores": lambda s, d: _rounded(checkpoints.interval_scores(checkpoints.frozen_costs(_blocks(s, d), LAST, SMALL_V)), "supported", "bits"),
    "prefix_bits": lambda s, d: _rounded(checkpoints.prefix_bits(_blocks(s, d), LAST, SMALL_V), "bits"),
    "markov1_regret": lambda s, d: _rounded(checkpoints.regret(_blocks(s, d), LAST, SMALL_V), "frozen_bits", "exact_bits", "regret"),
    "prefix_profiles": lambda s, d: checkpoints.prefix_profiles(_blocks(s, d), LAST).select("checkpoint", profiles.spelled(F.col("profile")).alias("profile"), "states"),
    "window_rings": _rings,
}

_B = f"""{_SMALL}, bl AS (SELECT CASE WHEN pos < 32 THEN 1 WHEN pos < 128 THEN 2 WHEN pos < 512 THEN 3 ELSE 4 END AS checkpoint, x1, y, CAST(count(*) AS BIGINT) AS n FROM l WHERE pos >= 2 GROUP BY ALL),
 up AS (SELECT k AS checkpoint, x1, y, CAST(sum(n) AS BIGINT) AS n FROM bl JOIN (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS k) ON checkpoint <= k GROUP BY ALL),
 fz AS (SELECT bl.*, u.n AS c, t.t FROM bl LEFT JOIN up u ON u.checkpoint = bl.checkpoint - 1 AND u.x1 = bl.x1 AND u.y = bl.y LEFT JOIN (SELECT checkpoint, x1, sum(n) AS t FROM up GROUP BY ALL) t ON t.checkpoint = bl.checkpoint - 1 AND t.x1 = bl.x1),
 sc AS (SELECT checkpoint, sum(n) AS scored, sum(CASE WHEN c IS NOT NULL THEN n ELSE 0 END) / sum(n) AS supported, sum(n * log2((coalesce(t, 0) + {SMALL_V / 2}) / (coalesce(c, 0) + 0.5))) AS bits FROM fz GROUP BY checkpoint),
 ex AS (SELECT checkpoint, sum(b) AS bits FROM (SELECT checkpoint, {kt(v=SMALL_V)} AS b FROM up GROUP BY checkpoint, x1) GROUP BY checkpoint)"""

ORACLE = {
    "graph_deltas": f"WITH {_B}, b AS (SELECT x1, y, min(checkpoint) AS checkpoint FROM bl GROUP BY ALL) SELECT checkpoint, count(*) AS edges, CAST(sum(count(*)) OVER (ORDER BY checkpoint) AS BIGINT) AS upto FROM b GROUP BY checkpoint",
    "interval_scores": f"WITH {_B} SELECT checkpoint, CAST(scored AS BIGINT) AS scored, round(supported, 4) AS supported, round(bits, 4) AS bits FROM sc",
    "prefix_bits": f"WITH {_B} SELECT checkpoint, round(bits, 4) AS bits FROM ex",
    "markov1_regret": f"WITH {_B}, g AS (SELECT checkpoint, bits - coalesce(lag(bits) OVER (ORDER BY checkpoint), 0) AS e FROM ex) SELECT checkpoint, round(bits, 4) AS frozen_bits, round(e, 4) AS exact_bits, round(bits - e, 4) AS regret FROM sc JOIN g USING (checkpoint)",
    "prefix_profiles": f"WITH {_B}, q AS (SELECT checkpoint, x1, string_agg(n::VARCHAR, ',' ORDER BY n DESC) AS profile FROM up GROUP BY ALL) SELECT checkpoint, profile, count(*) AS states FROM q GROUP BY ALL",
    "window_rings": f"""WITH {_SMALL}, an AS (SELECT x1, y, count(*) AS c FROM l WHERE pos >= 1 AND pos < 64 GROUP BY ALL), ta AS (SELECT x1, sum(c) AS t FROM an GROUP BY x1),
 rg AS (SELECT CASE WHEN pos < 80 THEN 16 WHEN pos < 128 THEN 64 WHEN pos < 320 THEN 256 ELSE 1024 END AS stop, x1, y FROM l WHERE pos >= 64 AND pos < 1088),
 s AS (SELECT stop, count(*) AS ring_tokens, sum(log2((coalesce(t, 0) + {SMALL_V / 2}) / (coalesce(c, 0) + 0.5))) AS ring_bits FROM rg LEFT JOIN an ON an.x1 = rg.x1 AND an.y = rg.y LEFT JOIN ta ON ta.x1 = rg.x1 GROUP BY stop)
 SELECT stop, CAST(sum(ring_tokens) OVER (ORDER BY stop) AS BIGINT) AS tokens, round(sum(ring_bits) OVER (ORDER BY stop), 4) AS bits, ring_tokens, round(ring_bits, 4) AS ring_bits FROM s""",
}
