"""Queries on entropies, families, context trees and accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.special import add_one_state_bits, kt_state_bits
from tallyflow.operators import context_tree, counting, entropy, families
from tallyflow.operators.entropy import subset_bits
from tallyflow.plans.shared import GRID, K, RANKED, TOK, V, add_one, capped_pairs, capped_triples, capped_triples_backoff, kt, tokens, vocab
from tallyflow.sources.tables import cut, read_table

PRODUCT_GRID = [(0, 0), (16, 0), (16, 4), (64, 4), (64, 16)]
LAGS = [0, 1, 2, 4]
DEPTH = 2


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    # Adding zero turns a rounded -0.0 into 0.0.
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


def _raw_state_bits(s: SparkSession, d: str) -> DataFrame:
    """The same over all symbols as states, the successor capped."""
    from tallyflow.operators import vocabulary

    return cut(vocabulary.capped(counting.context_counts(tokens(s, d), [1]), vocab(s, d), ["y"], K), "pairs")


def _buckets(s: SparkSession, d: str) -> DataFrame:
    pairs = _raw_state_bits(s, d)
    states = pairs.groupBy("x1").agg(F.sum("n").alias("tokens"), kt_state_bits("n", V).alias("model_bits"))
    report = entropy.state_report(pairs, "x1").drop("tokens").join(states, "x1")
    return _rounded(entropy.redundancy_buckets(report), "model_bits", "plugin_bits", "miller_madow_bits", "excess_bits")


def _order2_forecast(s: SparkSession, d: str) -> DataFrame:
    """Plug-in, Miller-Madow and a forecast of the second order's KT bits from the first order's excess by visits.

    The excess per state of each bucket of visits is learnt on first-order states and applied to
    second-order ones: forecast = plug-in + Miller-Madow + mean excess of the bucket.
    """
    learnt = entropy.redundancy_buckets(_state_report_raw(_raw_state_bits(s, d), ["x1"])).select("upto", (F.col("excess_bits") / F.col("states")).alias("mean_excess"))
    second = _state_report_raw(capped_triples(s, d), ["x1", "x2"]).withColumn("upto", entropy.visit_bucket(F.col("tokens")))
    joined = second.join(F.broadcast(learnt), "upto", "left").withColumn("mean_excess", F.coalesce("mean_excess", F.lit(0.0)))
    out = joined.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("states"), F.sum("plugin_bits").alias("plugin_bits"), F.sum("miller_madow_bits").alias("miller_madow_bits"), F.sum(F.col("plugin_bits") + F.col("miller_madow_bits") + F.col("mean_excess")).alias("forecast_bits"), F.sum("model_bits").alias("model_bits"))
    return _rounded(out, "plugin_bits", "miller_madow_bits", "forecast_bits", "model_bits", digits=3)


def _state_report_raw(pairs: DataFrame, keys: list[str]) -> DataFrame:
    from tallyflow.functions.special import LN2, xlog2x

    n = F.sum("n")
    return pairs.groupBy(*keys).agg(n.alias("tokens"), (xlog2x(n) - F.sum(xlog2x(F.col("n")))).alias("plugin_bits"), ((F.count("*") - 1) / (2 * LN2)).alias("miller_madow_bits"), kt_state_bits("n", V).alias("model_bits"))


def _context_probe(s: SparkSession, d: str) -> DataFrame:
    """H(y), H(y | previous), H(y | previous content): content is a letter or digit run, looked up strictly before.

    Between two neighbouring content positions the latest content symbol is the same, so each such stretch
    is cut from the array and expanded; no window orders a sequence.
    """
    stream = tokens(s, d)
    with_keys = stream.select("syms", F.expr("filter(transform(syms, (v, i) -> if(v rlike '^[A-Za-z0-9]', i, -1)), i -> i >= 0)").alias("at"))
    stretches = with_keys.filter("size(at) > 0").select(
        F.explode(F.expr("transform(at, (p, k) -> named_struct('state', syms[p], 'body', slice(syms, p + 2, if(k + 1 < size(at), at[k + 1] + 1, size(syms)) - p - 1), 'prev', slice(syms, p + 1, if(k + 1 < size(at), at[k + 1] + 1, size(syms)) - p - 1)))")).alias("e")
    )
    rows = stretches.select(F.col("e.state").alias("content"), F.inline(F.arrays_zip(F.col("e.body").alias("y"), F.col("e.prev").alias("x1"))))
    rows = rows.toDF("content", "y", "x1")
    cells = cut(rows.groupBy("content", "x1", "y").agg(F.count("*").alias("n")), "cells")
    sums = lambda *k: cells.groupBy(*k).agg(F.sum("n").alias("n"))
    plain = entropy.entropy(sums("y")).select(F.lit("none").alias("state"), "n", "bits")
    prev = entropy.conditional_entropy(sums("x1", "y"), "x1").select(F.lit("previous").alias("state"), "n", "bits")
    last = entropy.conditional_entropy(sums("content", "y"), "content").select(F.lit("content").alias("state"), "n", "bits")
    return _rounded(plain.unionByName(prev).unionByName(last), "bits", digits=6)


def _state_family(s: SparkSession, d: str, leaf: str) -> DataFrame:
    members = families.member_bits(families.state_members(capped_pairs(s, d), GRID), ["m"], ["state"], V, leaf)
    return _rounded(families.mixture(members, ["m"]), "bits", "posterior", "family_bits")


def _product_family(s: SparkSession, d: str) -> DataFrame:
    members = families.member_bits(families.product_members(capped_triples_backoff(s, d), PRODUCT_GRID), ["m1", "m2"], ["s1", "s2"], V)
    return _rounded(families.mixture(members, ["m1", "m2"]), "bits", "posterior", "family_bits")


def _lag_family(s: SparkSession, d: str) -> DataFrame:
    from tallyflow.operators import vocabulary

    counts = vocabulary.capped(counting.lag_counts(tokens(s, d), LAGS), vocab(s, d), ["y", "x"], K)
    # Lag 0 has one state: its empty symbol is unknown to the vocabulary, so it is K throughout.
    members = families.member_bits(counts, ["lag"], ["x"], V)
    return _rounded(families.mixture(members, ["lag"]), "bits", "posterior", "family_bits")


def _tree(s: SparkSession, d: str) -> DataFrame:
    return context_tree.node_bits(counting.context_nodes(capped_triples(s, d), DEPTH), DEPTH, V)


def _tree_at(s: SparkSession, d: str, depth: int) -> DataFrame:
    counts = capped_triples(s, d).groupBy("y", *[f"x{i}" for i in range(1, depth + 1)]).agg(F.sum("n").alias("n"))
    scored = context_tree.node_bits(counting.context_nodes(counts, depth), depth, V)
    return _rounded(context_tree.tree_summary(context_tree.weigh(scored, depth)), "tree_bits", "map_bits")


def _honest(s: SparkSession, d: str) -> DataFrame:
    """All costs of a first-order code of the texts: symbols, kept subset, spelled-out rest; and bits per byte."""
    pairs = capped_pairs(s, d)
    data = pairs.groupBy("x1").agg(kt_state_bits("n", V).alias("b")).agg(F.sum("b").alias("bits"))
    stream = cut(counting.symbol_counts(tokens(s, d)), "counts")
    distinct = stream.agg(F.count("*").alias("k"))
    from tallyflow.operators import vocabulary

    hidden = vocabulary.escape_payload(stream, vocab(s, d))
    escape = hidden.withColumn("k", distinct.scalar()).agg(F.sum(F.col("n") * F.log(F.col("k").cast("double")) / F.log(F.lit(2.0))).alias("bits"))
    docs = read_table(s, d, "documents").agg(F.sum(F.octet_length("text")).alias("b"))
    rows = data.select(F.lit("data").alias("part"), "bits").unionByName(escape.select(F.lit("escape").alias("part"), F.coalesce("bits", F.lit(0.0)).alias("bits")))
    n_subset = distinct.select(F.lit("subset").alias("part"), _choose_column(F.col("k"), K).alias("bits"))
    rows = rows.unionByName(n_subset)
    each = rows.withColumn("n_bytes", docs.scalar())
    return each.select("part", F.round("bits", 3).alias("bits"), F.round(families.bits_per_character(F.col("bits"), F.col("n_bytes")), 6).alias("bpc"))


def _choose_column(n, k: int):
    from tallyflow.functions.special import LN2, lgamma

    return (lgamma(n + 1.0) - lgamma(F.lit(k + 1.0)) - lgamma(n - float(k) + 1.0)) / LN2


QUERIES = {
    "empirical_entropy": lambda s, d: _rounded(entropy.entropy(counting.symbol_counts(tokens(s, d))), "bits", digits=6),
    "entropy_by_kind": lambda s, d: _rounded(
        entropy.entropy(_kinds(s, d), ["kind"]), "bits", digits=6
    ),
    "conditional_entropy": lambda s, d: _rounded(entropy.conditional_entropy(counting.context_counts(tokens(s, d), [1]), "x1"), "bits", digits=6),
    "mutual_information": lambda s, d: _rounded(entropy.mutual_information(counting.context_counts(tokens(s, d), [1]), "y", "x1"), "bits", digits=6),
    "state_grain": lambda s, d: _rounded(entropy.grain_curve(capped_pairs(s, d), GRID, "x1"), "bits", digits=6),
    "mass_quantiles": lambda s, d: entropy.mass_quantiles(counting.symbol_counts(tokens(s, d))),
    "miller_madow": lambda s, d: _rounded(entropy.state_report(capped_pairs(s, d), "x1"), "plugin_bits", "miller_madow_bits"),
    "redundancy_buckets": _buckets,
    "order2_forecast": _order2_forecast,
    "context_probe": _context_probe,
    "pair_plugin_loss": lambda s, d: _rounded(entropy.conditional_log_loss(capped_pairs(s, d), lambda c: (c + 0.5) / F.lit(1.0), "x1"), "bits", digits=6),
    "marginal_bound": lambda s, d: _marginal_bound(cut(capped_pairs(s, d), "pairs")),
    "kt_state_bits": lambda s, d: _rounded(capped_pairs(s, d).groupBy("x1").agg(F.sum("n").alias("n"), kt_state_bits("n", V).alias("bits")), "bits"),
    "addone_state_bits": lambda s, d: _rounded(capped_pairs(s, d).groupBy("x1").agg(F.sum("n").alias("n"), add_one_state_bits("n", V).alias("bits")), "bits"),
    "state_family_kt": lambda s, d: _state_family(s, d, "kt"),
    "state_family_addone": lambda s, d: _state_family(s, d, "add_one"),
    "product_family_kt": _product_family,
    "lag_family_kt": _lag_family,
    "ctw_kt_d1": lambda s, d: _tree_at(s, d, 1),
    "ctw_kt_d2": lambda s, d: _tree_at(s, d, 2),
    "fixed_depth_kt": lambda s, d: _rounded(context_tree.fixed_depths(_tree(s, d)), "bits"),
    "map_leaves": lambda s, d: context_tree.map_leaves(context_tree.weigh(_tree(s, d), DEPTH), DEPTH),
    "honest_bpc_kt": _honest,
    "subset_bits": lambda s, d: s.range(1).select(*[F.round(F.lit(subset_bits(n, k)), 6).alias(f"bits_{n}_{k}") for n, k in ((64, 8), (1024, 100), (16384, 4096))]),
}


def _marginal_bound(pairs: DataFrame) -> DataFrame:
    bits = pairs.groupBy("x1").agg(kt_state_bits("n", V).alias("model_bits"))
    return _rounded(entropy.marginal_bound(pairs, "x1", bits), "model_bits", "bound_bits")


def _kinds(s: SparkSession, d: str) -> DataFrame:
    from tallyflow.sources import streams

    docs = read_table(s, d, "documents").filter("text is not null").select("kind", F.regexp_extract_all("text", F.lit(streams.SEGMENT), F.lit(0)).alias("syms"))
    docs = streams.positions(docs, "kind")
    return docs.groupBy("kind", "sym").agg(F.count("*").alias("n"))


_X = "x1"
_STATE = "sum(n) * log2(sum(n)) - sum(n * log2(n))"
_MM = "(count(*) - 1) / (2 * ln(2.0))"
_RAWP = f"{RANKED}, rl AS (SELECT y, lag(sym) OVER (PARTITION BY doc_id ORDER BY pos) AS x1 FROM (SELECT r.doc_id, r.pos, r.y, tok.sym FROM r JOIN tok ON tok.doc_id = r.doc_id AND tok.pos = r.pos)), rp AS (SELECT y, x1, CAST(count(*) AS BIGINT) AS n FROM rl WHERE x1 IS NOT NULL GROUP BY ALL)"
_BUCKET = "CASE WHEN tokens <= 1 THEN 1 WHEN tokens <= 2 THEN 2 WHEN tokens <= 5 THEN 5 WHEN tokens <= 10 THEN 10 WHEN tokens <= 30 THEN 30 WHEN tokens <= 100 THEN 100 WHEN tokens <= 300 THEN 300 WHEN tokens <= 1000 THEN 1000 WHEN tokens <= 10000 THEN 10000 WHEN tokens <= 100000 THEN 100000 ELSE 1000000000 END"
_REPORT = f"{_RAWP}, st AS (SELECT x1, CAST(sum(n) AS BIGINT) AS tokens, {_STATE} AS plugin, {_MM} AS mm, {kt()} AS model FROM rp GROUP BY x1), bu AS (SELECT CAST({_BUCKET} AS BIGINT) AS upto, count(*) AS states, CAST(sum(tokens) AS BIGINT) AS tokens, sum(model) AS model, sum(plugin) AS plugin, sum(mm) AS mm FROM st GROUP BY 1)"


def _mix(members: str, names: str) -> str:
    """SQL: a family's mixture over ``names, states, n_coded, bits``."""
    return f"""SELECT {names}, states, n_coded, round(bits, 4) AS bits, round(pow(2.0, least_bits - bits) / s, 4) AS posterior, round(least_bits - log2(s) + log2(k), 4) AS family_bits, bits = least_bits AS best
 FROM (SELECT *, sum(pow(2.0, least_bits - bits)) OVER () AS s, count(*) OVER () AS k FROM (SELECT *, min(bits) OVER () AS least_bits FROM ({members})))"""


def _family(cells: str, names: str, states: str, leaf: str) -> str:
    return f"SELECT {names}, count(*) AS states, CAST(sum(n) AS BIGINT) AS n_coded, sum(bits) AS bits FROM (SELECT {names}, {states}, sum(n) AS n, {leaf} AS bits FROM ({cells}) GROUP BY ALL) GROUP BY {names}"


_CELLS_M = "SELECT m, least(x1, m) AS state, y, sum(n) AS n FROM pr, (SELECT CAST(unnest([0, 4, 16, 64]) AS INTEGER) AS m) GROUP BY ALL"
_CELLS_P = "SELECT m1, m2, least(x1, m1) AS s1, least(x2, m2) AS s2, y, sum(n) AS n FROM tb, (VALUES (0, 0), (16, 0), (16, 4), (64, 4), (64, 16)) g(m1, m2) GROUP BY ALL"
_CELLS_L = """SELECT lag, x, y, count(*) AS n FROM (SELECT y, lag(y) OVER w AS a, lag(y, 2) OVER w AS b, lag(y, 4) OVER w AS d, pos FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) q,
 LATERAL (SELECT unnest([0, 1, 2, 4]) AS lag, unnest([64, a, b, d]) AS x) z WHERE pos >= 4 GROUP BY ALL"""
_NODES = f"nq AS (SELECT 2 - grouping(x1) - grouping(x2) AS d, x1, x2, y, sum(n) AS n FROM tr GROUP BY y, ROLLUP (x1, x2)), no AS (SELECT d, x1, x2, CAST(sum(n) AS BIGINT) AS n, -{kt()} AS q FROM nq GROUP BY d, x1, x2)"
_HALF = lambda a, b: f"greatest({a}, {b}) + log2(1 + pow(2.0, least({a}, {b}) - greatest({a}, {b}))) - 1"
_WEIGHED = f"""{_NODES}, k2 AS (SELECT x1, sum(q) AS kids FROM no WHERE d = 2 GROUP BY x1),
 w1 AS (SELECT no.x1, no.n, no.q, {_HALF('q', 'kids')} AS beta, greatest(q, kids) - 1 AS gamma, kids > q AS split FROM no JOIN k2 ON no.x1 = k2.x1 WHERE d = 1),
 w0 AS (SELECT no.n, no.q, {_HALF('q', 'kb')} AS beta, greatest(q, kg) - 1 AS gamma, kg > q AS split FROM no, (SELECT sum(beta) AS kb, sum(gamma) AS kg FROM w1) WHERE d = 0)"""

ORACLE = {
    "empirical_entropy": f"WITH {TOK} SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS types, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM (SELECT sym, count(*) AS n FROM tok GROUP BY sym)",
    "entropy_by_kind": f"WITH {TOK} SELECT kind, CAST(sum(n) AS BIGINT) AS n, count(*) AS types, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM (SELECT kind, sym, count(*) AS n FROM tok JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY kind",
    "conditional_entropy": f"""WITH {TOK}, l AS (SELECT sym, lag(sym) OVER (PARTITION BY doc_id ORDER BY pos) AS x FROM tok), c AS (SELECT x, sym, count(*) AS n FROM l WHERE x IS NOT NULL GROUP BY ALL), s AS (SELECT x, sum(n) AS t FROM c GROUP BY x)
 SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS pairs, count(DISTINCT c.x) AS states, round(-sum(n * log2(n / t)) / sum(n), 6) AS bits FROM c JOIN s ON c.x = s.x""",
    "mutual_information": f"""WITH {TOK}, l AS (SELECT sym AS y, lag(sym) OVER (PARTITION BY doc_id ORDER BY pos) AS x FROM tok), c AS (SELECT x, y, count(*) AS n FROM l WHERE x IS NOT NULL GROUP BY ALL),
 q AS (SELECT n, sum(n) OVER (PARTITION BY x) AS a, sum(n) OVER (PARTITION BY y) AS b, sum(n) OVER () AS t FROM c) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n / t * log2(CAST(n AS DOUBLE) * t / (CAST(a AS DOUBLE) * b))), 6) AS bits FROM q""",
    "state_grain": f"WITH {RANKED}, g AS ({_CELLS_M}), s AS (SELECT m, state, sum(n) AS n, sum(n * log2(n)) AS f, count(*) AS p FROM g GROUP BY ALL) SELECT m, CAST(sum(n) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS pairs, count(*) AS states, round((sum(n * log2(n)) - sum(f)) / sum(n), 6) AS bits FROM s GROUP BY m",
    "mass_quantiles": f"WITH {TOK}, c AS (SELECT row_number() OVER w AS rank, sum(n) OVER w AS upto, sum(n) OVER () AS total FROM (SELECT sym, count(*) AS n FROM tok GROUP BY sym) WINDOW w AS (ORDER BY n DESC, sym)) SELECT share, CAST(min(rank) AS INTEGER) AS ranks FROM c, (SELECT CAST(unnest([0.5, 0.9, 0.99]) AS DOUBLE) AS share) WHERE upto >= share * total GROUP BY share",
    "miller_madow": f"WITH {RANKED} SELECT x1, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS support, round({_STATE}, 4) AS plugin_bits, round({_MM}, 4) AS miller_madow_bits FROM pr GROUP BY x1",
    "redundancy_buckets": f"WITH {_REPORT} SELECT upto, states, tokens, round(model, 4) AS model_bits, round(plugin, 4) AS plugin_bits, round(mm, 4) AS miller_madow_bits, round(model - plugin - mm, 4) AS excess_bits FROM bu",
    "order2_forecast": f"""WITH {_REPORT}, ex AS (SELECT upto, (model - plugin - mm) / states AS e FROM bu), s2 AS (SELECT x1, x2, CAST(sum(n) AS BIGINT) AS tokens, {_STATE} AS plugin, {_MM} AS mm, {kt()} AS model FROM tr GROUP BY x1, x2),
 b2 AS (SELECT *, CAST({_BUCKET} AS BIGINT) AS upto FROM s2) SELECT CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS states, round(sum(plugin), 3) AS plugin_bits, round(sum(mm), 3) AS miller_madow_bits, round(sum(plugin + mm + coalesce(e, 0)), 3) AS forecast_bits, round(sum(model), 3) AS model_bits FROM b2 LEFT JOIN ex USING (upto)""",
    "context_probe": f"""WITH {TOK}, l AS (SELECT sym AS y, lag(sym) OVER w AS x, last_value(CASE WHEN regexp_matches(sym, '^[A-Za-z0-9]') THEN sym END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 k AS (SELECT * FROM l WHERE c IS NOT NULL), h AS (SELECT 'none' AS state, '' AS s, y, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'previous', x, y, count(*) FROM k GROUP BY ALL UNION ALL SELECT 'content', c, y, count(*) FROM k GROUP BY ALL),
 g AS (SELECT state, s, sum(n) AS n, sum(n * log2(n)) AS f FROM h GROUP BY ALL) SELECT state, CAST(sum(n) AS BIGINT) AS n, round((sum(n * log2(n)) - sum(f)) / sum(n), 6) AS bits FROM g GROUP BY state""",
    "pair_plugin_loss": f"WITH {RANKED}, s AS (SELECT x1, sum(n) AS n, sum(n + 0.5) AS m, sum(n * log2(n + 0.5)) AS l FROM pr GROUP BY x1) SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * log2(m) - l) / sum(n), 6) AS bits FROM s",
    "marginal_bound": f"""WITH {RANKED}, p AS (SELECT y, log2(sum(sum(n)) OVER () / sum(n)) AS price FROM pr GROUP BY y), c AS (SELECT x1, sum(n * price) AS b, {kt()} AS model FROM pr JOIN p USING (y) GROUP BY x1)
 SELECT count(*) AS states, round(sum(model), 4) AS model_bits, round(sum(least(b, model) + 1), 4) AS bound_bits, count(*) FILTER (b < model) AS better FROM c""",
    "kt_state_bits": f"WITH {RANKED} SELECT x1, CAST(sum(n) AS BIGINT) AS n, round({kt()}, 4) AS bits FROM pr GROUP BY x1",
    "addone_state_bits": f"WITH {RANKED} SELECT x1, CAST(sum(n) AS BIGINT) AS n, round({add_one()}, 4) AS bits FROM pr GROUP BY x1",
    "state_family_kt": f"WITH {RANKED} {_mix(_family(_CELLS_M, 'm', 'state', kt()), 'm')}",
    "state_family_addone": f"WITH {RANKED} {_mix(_family(_CELLS_M, 'm', 'state', add_one()), 'm')}",
    "product_family_kt": f"WITH {RANKED} {_mix(_family(_CELLS_P, 'm1, m2', 's1, s2', kt()), 'm1, m2')}",
    "lag_family_kt": f"WITH {RANKED} {_mix(_family(_CELLS_L, 'lag', 'x', kt()), 'lag')}",
    "ctw_kt_d1": f"WITH {RANKED}, {_NODES}, k1 AS (SELECT sum(q) AS kids FROM no WHERE d = 1) SELECT n AS n_coded, round(-({_HALF('q', 'kids')}), 4) AS tree_bits, round(-(greatest(q, kids) - 1), 4) AS map_bits FROM no, k1 WHERE d = 0",
    "ctw_kt_d2": f"WITH {RANKED}, {_WEIGHED} SELECT n AS n_coded, round(-beta, 4) AS tree_bits, round(-gamma, 4) AS map_bits FROM w0",
    "fixed_depth_kt": f"WITH {RANKED}, {_NODES} SELECT CAST(d AS INTEGER) AS d, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS n_coded, round(-sum(q), 4) AS bits FROM no GROUP BY d",
    "map_leaves": f"""WITH {RANKED}, {_WEIGHED}, a AS (SELECT 0 AS d, n FROM w0 WHERE NOT split UNION ALL SELECT 1, w1.n FROM w1, w0 WHERE w0.split AND NOT w1.split
 UNION ALL SELECT 2, no.n FROM no JOIN w1 ON no.x1 = w1.x1, w0 WHERE no.d = 2 AND w0.split AND w1.split) SELECT d, count(*) AS leaves, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY d""",
    "honest_bpc_kt": f"""WITH {RANKED}, k AS (SELECT count(DISTINCT sym) AS k FROM tok), p AS (SELECT 'data' AS part, (SELECT sum(b) FROM (SELECT {kt()} AS b FROM pr GROUP BY x1)) AS bits
 UNION ALL SELECT 'escape', (SELECT count(*) FROM tok WHERE sym NOT IN (SELECT sym FROM voc)) * log2((SELECT k FROM k)) UNION ALL SELECT 'subset', (SELECT (lgamma(k + 1) - lgamma({K + 1}) - lgamma(k - {K} + 1)) / ln(2.0) FROM k))
 SELECT part, round(bits, 3) AS bits, round(bits / (SELECT sum(octet_length(encode(text))) FROM documents), 6) AS bpc FROM p""",
    "subset_bits": "SELECT round((lgamma(65) - lgamma(9) - lgamma(57)) / ln(2.0), 6) AS bits_64_8, round((lgamma(1025) - lgamma(101) - lgamma(925)) / ln(2.0), 6) AS bits_1024_100, round((lgamma(16385) - lgamma(4097) - lgamma(12289)) / ln(2.0), 6) AS bits_16384_4096",
}
