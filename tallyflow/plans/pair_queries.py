"""Queries on pooled lags, pair models, schemes, tokenizer streams, estimates and streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions.special import kt_state_bits, log2
from tallyflow.operators import counting, entropy, ordered, pair_models, pooled, sampling, tokenizer, vocabulary
from tallyflow.plans.model_queries import _rounded
from tallyflow.plans.shared import K, RANKED, TOK, V, capped_pairs, kt, tokens, vocab
from tallyflow.sources.tables import cut, read_table
from tallyflow.streaming import counts as streamed

#: A small vocabulary for models that are dense in the alphabet.
SMALL = 16
SMALL_V = SMALL + 1
LAGS = [1, 2]
EDGES = [2, 64, 512, None]
MIXES = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.2, 0.5, 0.3], [0.1, 0.8, 0.1]]
POWERS = [[1.0, 0.0], [0.0, 1.0], [0.66, 0.33], [1.0, 0.5]]
CHUNKS = [1, 2, 4, 8]


def _small_vocab(s: SparkSession, d: str) -> DataFrame:
    return vocab(s, d, SMALL)


def _experts(s: SparkSession, d: str):
    stream, kept = tokens(s, d), _small_vocab(s, d)
    # Laws and cells are small and read several times: they are written once.
    tables = cut(pooled.prefix_tables(stream, kept, SMALL, LAGS, EDGES), "prefix")
    q0, laws = (cut(x, "laws") for x in pooled.expert_laws(tables, LAGS, SMALL_V))
    cells = cut(pooled.block_cells(stream, kept, SMALL, LAGS, EDGES), "blocks")
    return pooled.expert_columns(cells, q0, laws, LAGS), q0, laws


def _pooled_mix(s: SparkSession, d: str) -> DataFrame:
    return _rounded(pooled.mixture_members(_experts(s, d)[0], MIXES), "bits", digits=3)


def _pooled_product(s: SparkSession, d: str) -> DataFrame:
    experts, q0, laws = _experts(s, d)
    return _rounded(pooled.product_members(experts, q0, laws, LAGS, POWERS), "bits", digits=3)


def _small_triples(s: SparkSession, d: str) -> DataFrame:
    return vocabulary.capped(counting.context_counts(tokens(s, d), LAGS), _small_vocab(s, d), ["y", "x1", "x2"], SMALL)


def _births(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    blocks = cut(pooled.block_cells(tokens(s, d), _small_vocab(s, d), SMALL, LAGS, EDGES), "blocks")
    name = {"y": "y", "x1": "a", "x2": "b"}
    blocks = blocks.select("checkpoint", *[F.col(k).alias(v) for k, v in name.items()])
    return pair_models.edge_births(blocks, "y", "a"), pair_models.edge_births(blocks, "y", "b"), pair_models.edge_births(blocks, "a", "b")


def _triangle_counts(s: SparkSession, d: str) -> DataFrame:
    return pair_models.triangles(*_births(s, d)).groupBy("birth").agg(F.count("*").alias("triangles"))


def _delta_triangles(s: SparkSession, d: str) -> DataFrame:
    births = _births(s, d)
    return pair_models.new_triangles(*births, 3)


def _fit(s: SparkSession, d: str) -> tuple[DataFrame, list]:
    """Three-factor fit of the seen (x1, x2) contexts: margins (y, x1), (y, x2) and (x1, x2) of the triples."""
    targets, support = pair_models.triple_margins(cut(_small_triples(s, d), "triples"))
    return pair_models.proportional_fit(cut(support.withColumn("q", F.lit(1.0)), "support"), targets, 8), targets


def _fit_error(s: SparkSession, d: str) -> DataFrame:
    cells, targets = _fit(s, d)
    return _rounded(pair_models.fit_error(cells, targets), "error", digits=6)


def _gated(s: SparkSession, d: str) -> DataFrame:
    cells, _ = _fit(s, d)
    scored = pair_models.gated_scores(pair_models.star_scores(cut(_small_triples(s, d), "triples")), cells)
    return _rounded(scored.agg(F.sum("n").alias("n"), (-F.sum(F.col("n") * F.col("log2p")) / F.sum("n")).alias("bits")), "bits")


def _anchored(s: SparkSession, d: str) -> DataFrame:
    """Anchored fits after 0 and 6 rounds against first order."""
    triples = cut(_small_triples(s, d), "triples")
    out = None
    for rounds in (0, 6):
        row = pair_models.anchored_scores(triples, pair_models.anchored_fit(triples, rounds)).select(F.lit(rounds).alias("rounds"), "n", "bits", "first_order_bits")
        out = row if out is None else out.unionByName(row)
    return _rounded(out, "bits", "first_order_bits")


def _chain(s: SparkSession, d: str) -> DataFrame:
    """Each checkpoint's anchored fit scored on the next block (cells it supports)."""
    blocks = cut(pooled.block_cells(tokens(s, d), _small_vocab(s, d), SMALL, LAGS, EDGES), "blocks")
    out = None
    for k, fitted in pair_models.fit_chain(blocks, [1, 2], 3):
        row = pair_models.anchored_scores(blocks.filter(F.col("checkpoint") == k + 1), fitted).select(F.lit(k + 1).alias("checkpoint"), "n", "bits", "first_order_bits")
        out = row if out is None else out.unionByName(row)
    return _rounded(out, "bits", "first_order_bits")


def _sinkhorn(s: SparkSession, d: str) -> DataFrame:
    """Pair counts plus a background brought to equal margins of y and x by alternate scaling."""
    pairs = cut(capped_pairs(s, d), "pairs")
    t = pairs.agg(F.sum("n").alias("t"))
    share = lambda c: pairs.groupBy(c).agg((F.sum("n") / F.lit(1.0)).alias("m")).withColumn("p", F.col("m") / t.scalar()).select(c, "p")
    rows, cols = cut(share("y"), "margin"), cut(share("x1"), "margin")
    # Every cell of the declared alphabet has background mass, so the scaling has a solution.
    grid = rows.select("y", F.col("p").alias("py"), F.explode(F.sequence(F.lit(0), F.lit(V - 1))).alias("x1")).join(cols.select("x1", F.col("p").alias("px")), "x1")
    law = grid.join(pairs, ["y", "x1"], "left").select("y", "x1", (F.coalesce("n", F.lit(0)) + F.col("py") * F.col("px")).alias("q"))
    fitted = pair_models.proportional_fit(law, [(["y"], rows), (["x1"], cols)], 4)
    return _rounded(pair_models.fit_error(fitted, [(["y"], rows), (["x1"], cols)]), "error", digits=6)


def _refresh_cost(s: SparkSession, d: str) -> DataFrame:
    """``chunks, n_coded, chunked_bits, exact_bits``: first-order KT with counts frozen at the start of each of C chunks.

    Exact is the sequential code, which telescopes to the final counts.
    """
    stream, kept = tokens(s, d), _small_vocab(s, d)
    out = None
    for c in CHUNKS:
        # The last chunk holds the rest of every text, wherever the edges before it lie.
        edges = [*(pooled.geometric_edges(2, 100_000, c)[:-1] if c > 1 else [2]), None]
        cells = cut(pooled.block_cells(stream, kept, SMALL, [1], edges), "blocks")
        before = counting.cumulative_counts(cells, ["y", "x1"], list(range(1, c + 1))).select((F.col("checkpoint") + 1).alias("checkpoint"), "y", "x1", F.col("n").alias("c"))
        totals = before.groupBy("checkpoint", "x1").agg(F.sum("c").alias("t"))
        joined = cells.join(before, ["checkpoint", "y", "x1"], "left").join(totals, ["checkpoint", "x1"], "left")
        cost = F.col("n") * log2((F.coalesce("t", F.lit(0)) + SMALL_V / 2.0) / (F.coalesce("c", F.lit(0)) + 0.5))
        chunked = joined.agg(F.sum("n").alias("n_coded"), F.sum(cost).alias("chunked_bits"))
        exact = cells.groupBy("y", "x1").agg(F.sum("n").alias("n")).groupBy("x1").agg(kt_state_bits("n", SMALL_V).alias("b")).agg(F.sum("b").alias("b"))
        row = chunked.select(F.lit(c).alias("chunks"), "n_coded", "chunked_bits").withColumn("exact_bits", exact.scalar())
        out = row if out is None else out.unionByName(row)
    return _rounded(out, "chunked_bits", "exact_bits", digits=3)


def _spelling(s: SparkSession, d: str) -> DataFrame:
    """KT bits of spelling every distinct word once: order 0 and order 1 over 27 symbols."""
    forms = tokenizer.form_counts(counting.symbol_counts(tokens(s, d))).filter("kind = 'word'")
    letters = forms.select(F.concat(F.array(F.lit("")), F.filter(F.split("form", ""), lambda c: c != ""), F.array(F.lit(""))).alias("syms"))
    pairs = cut(counting.context_counts(letters, [1]), "letters")
    zero = pairs.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("symbols"), kt_state_bits("n", 27).alias("bits0"))
    one = pairs.groupBy("x1").agg(kt_state_bits("n", 27).alias("b")).agg(F.sum("b").alias("b"))
    return _rounded(zero.withColumn("bits1", one.scalar()), "bits0", "bits1", digits=3)


def _token_costs(s: SparkSession, d: str) -> DataFrame:
    """``stream, types, symbols, bits``: KT bits of the tokenizer's streams; S1's alphabet is 259 and the forms."""
    prof = cut(tokenizer.stream_profiles(cut(counting.symbol_counts(tokens(s, d)), "counts")), "profiles")
    sizes = {"S2a": 27, "S2b": 11, "S3": 4}
    parts = [prof.filter(F.col("stream") == k).groupBy("stream").agg(F.count("*").alias("types"), F.sum("n").alias("symbols"), kt_state_bits("n", v).alias("bits")) for k, v in sizes.items()]
    s1 = prof.filter("stream = 'S1'").groupBy("stream").agg(F.count("*").alias("types"), F.sum("n").alias("symbols"), F.sum("n").alias("_n"), F.sum(_half_gamma("n")).alias("_g"), F.sum(F.when(F.col("symbol").startswith("first "), F.col("n")).otherwise(0)).alias("_forms"))
    from tallyflow.functions.special import LN2, lgamma

    half = (F.col("_forms") + 259) / 2.0
    s1 = s1.select("stream", "types", "symbols", ((lgamma(F.col("_n") + half) - lgamma(half) - F.col("_g")) / LN2).alias("bits"))
    out = s1
    for p in parts:
        out = out.unionByName(p)
    return _rounded(out, "bits", digits=3)


def _half_gamma(c: str):
    import math

    from tallyflow.functions.special import lgamma

    return lgamma(F.col(c) + 0.5) - math.lgamma(0.5)


def _roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Per document: tokens, forms, and whether decoding gives the text again."""
    docs = read_table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    enc = tokenizer.encode_texts(docs)
    back = tokenizer.decode_texts(enc).withColumnRenamed("text", "back")
    sizes = enc.select("doc_id", F.size("tokens").alias("tokens"), F.size("vocabulary").alias("forms"))
    return docs.join(back, "doc_id").join(sizes, "doc_id").select("doc_id", "tokens", "forms", (F.col("text") == F.col("back")).alias("same"))


def _stratified(s: SparkSession, d: str) -> DataFrame:
    docs = read_table(s, d, "documents").select(F.col("kind").alias("stratum"), F.col("n_chars").cast("double").alias("value"))
    sizes = docs.groupBy("stratum").agg(F.count("*").alias("size"))
    return _rounded(sampling.stratified_estimate(docs, sizes), "estimate", "total", "standard_error", "low", "high")


def _lag_information(s: SparkSession, d: str) -> DataFrame:
    counts = cut(vocabulary.capped(counting.lag_counts(tokens(s, d), list(range(1, 9))), _small_vocab(s, d), ["x", "y"], SMALL), "lags")
    base = entropy.entropy(counts.groupBy("lag", "y").agg(F.sum("n").alias("n")), ["lag"]).select("lag", F.col("bits").alias("h"))
    cond = entropy.conditional_entropy(counts, "x", ["lag"]).select("lag", F.col("bits").alias("c"))
    return base.join(cond, "lag").select("lag", (F.col("h") - F.col("c")).alias("bits"))


QUERIES = {
    "pooled_counts_mix": _pooled_mix,
    "pooled_counts_product": _pooled_product,
    "lag_pair_score": lambda s, d: _rounded(pair_models.pair_scores(capped_pairs(s, d)), "log2p", digits=6),
    "star_score": lambda s, d: _rounded(pair_models.star_scores(cut(_small_triples(s, d), "triples")), "log2p", digits=6),
    "triangle_counts": _triangle_counts,
    "delta_triangles": _delta_triangles,
    "ipf_fit": _fit_error,
    "gated_score": _gated,
    "anchored_scores": _anchored,
    "anchored_chain": _chain,
    "sinkhorn_projection": _sinkhorn,
    "chunked_kt": _refresh_cost,
    "spelling_stream": _spelling,
    "case_histogram": lambda s, d: tokenizer.case_histogram(counting.symbol_counts(tokens(s, d))),
    "token_streams": _token_costs,
    "tokenizer_roundtrip": _roundtrip,
    "stratified_estimate": _stratified,
    "bootstrap_interval": lambda s, d: sampling.bootstrap_interval(read_table(s, d, "documents").select(F.col("kind").alias("stratum"), F.col("n_chars").cast("double").alias("value")), read_table(s, d, "documents").groupBy(F.col("kind").alias("stratum")).agg(F.count("*").alias("size"))),
    "lag_information": lambda s, d: _rounded(_lag_information(s, d), "bits", digits=6),
    "lag_decay_fit": lambda s, d: _rounded(sampling.decay_fits(_lag_information(s, d)), "power_slope", "power_scale", "exp_slope", "exp_scale", digits=5),
    "event_pairs": lambda s, d: ordered.lagged_counts(read_table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", 1),
    "event_contexts": lambda s, d: ordered.lagged_counts(read_table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", 2),
    "order_status_pairs": lambda s, d: ordered.lagged_counts(read_table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", 1),
    "returnflag_pairs": lambda s, d: ordered.lagged_counts(read_table(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], "l_returnflag", 1),
    "global_pair_counts": lambda s, d: ordered.global_pair_counts(tokens(s, d), "doc_id"),
    "streaming_counts": lambda s, d: streamed.incremental_counts(s, f"{d}/events.parquet", ["event_type"]),
    "streaming_windows": lambda s, d: streamed.windowed_counts(s, f"{d}/events.parquet", "ts", "event_type"),
    "streaming_causal": lambda s, d: streamed.causal_scores(s, f"{d}/documents.parquet", "kind"),
}

_SMALL = RANKED.replace(f"<= {K})", f"<= {SMALL})").replace(f"coalesce(rank, {K})", f"coalesce(rank, {SMALL})")
_POOL = f"""{_SMALL}, b AS (SELECT *, CASE WHEN pos < 2 THEN 0 WHEN pos < 64 THEN 1 WHEN pos < 512 THEN 2 ELSE 3 END AS blk FROM l),
 ck AS (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS c), ys AS (SELECT CAST(unnest(range(0, {SMALL_V})) AS INTEGER) AS y),
 u AS (SELECT c, y, count(*) AS n FROM b JOIN ck ON blk < c GROUP BY ALL), up AS (SELECT c, sum(n) AS t FROM u GROUP BY c),
 q0 AS (SELECT up.c, ys.y, (coalesce(n, 0) + 0.5) / (t + {SMALL_V} / 2.0) AS q0 FROM up CROSS JOIN ys LEFT JOIN u ON u.c = up.c AND u.y = ys.y),
 g1 AS (SELECT c, x1, y, count(*) AS n FROM b JOIN ck ON blk < c WHERE pos >= 1 GROUP BY ALL), r1 AS (SELECT c, x1, sum(n) AS t FROM g1 GROUP BY ALL),
 g2 AS (SELECT c, x2, y, count(*) AS n FROM b JOIN ck ON blk < c WHERE pos >= 2 GROUP BY ALL), r2 AS (SELECT c, x2, sum(n) AS t FROM g2 GROUP BY ALL),
 cells AS (SELECT blk AS c, y, x1, x2, count(*) AS n FROM b WHERE blk BETWEEN 1 AND 3 GROUP BY ALL),
 e AS (SELECT cells.*, q0.q0, (coalesce(g1.n, 0) + q0) / (coalesce(r1.t, 0) + 1) / q0 AS r1, (coalesce(g2.n, 0) + q0) / (coalesce(r2.t, 0) + 1) / q0 AS r2 FROM cells JOIN q0 USING (c, y)
  LEFT JOIN g1 ON g1.c = cells.c AND g1.x1 = cells.x1 AND g1.y = cells.y LEFT JOIN r1 ON r1.c = cells.c AND r1.x1 = cells.x1 LEFT JOIN g2 ON g2.c = cells.c AND g2.x2 = cells.x2 AND g2.y = cells.y LEFT JOIN r2 ON r2.c = cells.c AND r2.x2 = cells.x2)"""
_STAR = f"""{_SMALL}, t AS (SELECT sum(n) AS t FROM tr), ys AS (SELECT y, sum(n) AS n FROM tr GROUP BY y), a AS (SELECT x1, sum(n) AS n FROM tr GROUP BY x1), bb AS (SELECT x2, sum(n) AS n FROM tr GROUP BY x2),
 ya AS (SELECT y, x1, sum(n) AS n FROM tr GROUP BY ALL), yb AS (SELECT y, x2, sum(n) AS n FROM tr GROUP BY ALL),
 pa AS (SELECT ys.y, a.x1, (coalesce(ya.n, 0) + ys.n / t * a.n / t) / (t + 1.0) AS p FROM ys CROSS JOIN a CROSS JOIN t LEFT JOIN ya ON ya.y = ys.y AND ya.x1 = a.x1),
 pb AS (SELECT ys.y, bb.x2, (coalesce(yb.n, 0) + ys.n / t * bb.n / t) / (t + 1.0) AS p FROM ys CROSS JOIN bb CROSS JOIN t LEFT JOIN yb ON yb.y = ys.y AND yb.x2 = bb.x2),
 w AS (SELECT pa.y, x1, x2, pa.p * pb.p / (ys.n / t) AS w FROM pa JOIN pb USING (y) JOIN ys USING (y) CROSS JOIN t), z AS (SELECT x1, x2, sum(w) AS z FROM w GROUP BY ALL)"""
_BIRTHS = f"""{_POOL}, e1 AS (SELECT y, x1 AS a, min(c) AS birth FROM cells GROUP BY ALL), e2 AS (SELECT y, x2 AS b, min(c) AS birth FROM cells GROUP BY ALL), e3 AS (SELECT x1 AS a, x2 AS b, min(c) AS birth FROM cells GROUP BY ALL),
 tg AS (SELECT e1.y, e1.a, e2.b, greatest(e1.birth, e2.birth, e3.birth) AS birth FROM e3 JOIN e1 USING (a) JOIN e2 ON e2.y = e1.y AND e2.b = e3.b)"""
_FORMS = f"""{TOK}, sc AS (SELECT sym, count(*) AS n FROM tok GROUP BY sym), fm AS (SELECT CASE WHEN regexp_matches(sym, '^[A-Za-z]+$') THEN 'word' WHEN regexp_matches(sym, '^[0-9]+$') THEN 'number' ELSE 'other' END AS kind,
 CASE WHEN regexp_matches(sym, '^[A-Za-z]+$') THEN lower(sym) ELSE sym END AS form, sum(n) AS n FROM sc GROUP BY ALL),
 cs AS (SELECT CASE WHEN regexp_matches(sym, '^[a-z]+$') THEN 'lower' WHEN regexp_matches(sym, '^[A-Z][a-z]*$') THEN 'Cap' WHEN regexp_matches(sym, '^[A-Z][A-Z]+$') THEN 'UPPER' ELSE 'mixed' END AS case_class, count(*) AS runs, CAST(sum(n) AS BIGINT) AS n FROM sc WHERE regexp_matches(sym, '^[A-Za-z]+$') GROUP BY 1)"""
_LAGINFO = f"""{_SMALL}, ll AS (SELECT y, pos, doc_id, {', '.join(f'lag(y, {i}) OVER w AS z{i}' for i in range(1, 9))} FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 lc AS ({' UNION ALL '.join(f'SELECT {i} AS lag, z{i} AS x, y, count(*) AS n FROM ll WHERE pos >= 8 GROUP BY ALL' for i in range(1, 9))}),
 li AS (SELECT lag, sum(n / t * log2(CAST(n AS DOUBLE) * t / (CAST(a AS DOUBLE) * b))) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY lag, x) AS a, sum(n) OVER (PARTITION BY lag, y) AS b, sum(n) OVER (PARTITION BY lag) AS t FROM lc) GROUP BY lag)"""
_CHUNK = []
for _c in CHUNKS:
    _edges = pooled.geometric_edges(2, 100_000, _c)[:-1] if _c > 1 else [2]
    _case = " ".join(["WHEN pos < 0 THEN 0", *[f"WHEN pos < {e} THEN {i}" for i, e in enumerate(_edges[1:], 1)]]) + f" ELSE {_c}"
    _CHUNK.append(
        f"""SELECT {_c} AS chunks, CAST(sum(n) AS BIGINT) AS n_coded, round(sum(n * log2((coalesce(t, 0) + {SMALL_V / 2}) / (coalesce(cc, 0) + 0.5))), 3) AS chunked_bits, (SELECT round(sum(b), 3) FROM (SELECT {kt(v=SMALL_V)} AS b FROM (SELECT x1, y, count(*) AS n FROM l WHERE pos >= 2 GROUP BY ALL) GROUP BY x1)) AS exact_bits
 FROM (SELECT *, sum(n) OVER (PARTITION BY x1, y ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cc, sum(n) OVER (PARTITION BY x1 ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM (SELECT CASE {_case} END AS k, x1, y, count(*) AS n FROM l WHERE pos >= 2 GROUP BY ALL))"""
    )

_MIXVALS = ", ".join(f"({i}, {', '.join(map(str, w))})" for i, w in enumerate(MIXES))
_POWVALS = ", ".join(f"({i}, {', '.join(map(str, w))})" for i, w in enumerate(POWERS))

ORACLE = {
    "pooled_counts_mix": f"WITH {_POOL} SELECT member, CAST(sum(n) AS BIGINT) AS n_coded, round(sum(-n * log2(q0 * (w0 + w1 * r1 + w2 * r2))), 3) AS bits FROM e, (VALUES {_MIXVALS}) m(member, w0, w1, w2) GROUP BY member",
    "pooled_counts_product": f"""WITH {_POOL}, cx AS (SELECT DISTINCT c, x1, x2 FROM cells), al AS (SELECT cx.c, cx.x1, cx.x2, q0.y, q0.q0, (coalesce(g1.n, 0) + q0) / (coalesce(r1.t, 0) + 1) / q0 AS r1, (coalesce(g2.n, 0) + q0) / (coalesce(r2.t, 0) + 1) / q0 AS r2 FROM cx JOIN q0 USING (c)
  LEFT JOIN g1 ON g1.c = cx.c AND g1.x1 = cx.x1 AND g1.y = q0.y LEFT JOIN r1 ON r1.c = cx.c AND r1.x1 = cx.x1 LEFT JOIN g2 ON g2.c = cx.c AND g2.x2 = cx.x2 AND g2.y = q0.y LEFT JOIN r2 ON r2.c = cx.c AND r2.x2 = cx.x2),
 zz AS (SELECT c, x1, x2, member, sum(q0 * pow(r1, b1) * pow(r2, b2)) AS z FROM al, (VALUES {_POWVALS}) m(member, b1, b2) GROUP BY ALL)
 SELECT member, CAST(sum(n) AS BIGINT) AS n_coded, round(sum(-n * (log2(q0) + b1 * log2(r1) + b2 * log2(r2) - log2(z))), 3) AS bits FROM e JOIN zz USING (c, x1, x2) JOIN (VALUES {_POWVALS}) m(member, b1, b2) USING (member) GROUP BY member""",
    "lag_pair_score": f"WITH {RANKED}, q AS (SELECT *, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER (PARTITION BY x1) AS na, sum(n) OVER () AS t FROM pr) SELECT y, x1, n, round(log2((n + ny / t * na / t) / ((t + 1.0) * na / t)), 6) AS log2p FROM q",
    "star_score": f"WITH {_STAR} SELECT tr.y, tr.x1, tr.x2, tr.n, round(log2(w / z), 6) + 0.0 AS log2p FROM tr JOIN w ON w.y = tr.y AND w.x1 = tr.x1 AND w.x2 = tr.x2 JOIN z ON z.x1 = tr.x1 AND z.x2 = tr.x2",
    "triangle_counts": f"WITH {_BIRTHS} SELECT birth, count(*) AS triangles FROM tg GROUP BY birth",
    "delta_triangles": f"WITH {_BIRTHS} SELECT y, a, b FROM tg WHERE birth = 3",
    "chunked_kt": f"WITH {_SMALL} " + " UNION ALL ".join(_CHUNK),
    "spelling_stream": f"""WITH {_FORMS}, w AS (SELECT DISTINCT form FROM fm WHERE kind = 'word'), ch AS (SELECT form, unnest(list_concat(regexp_extract_all(form, '[a-z]'), [''])) AS y, unnest(list_concat([''], regexp_extract_all(form, '[a-z]'))) AS x FROM w),
 p AS (SELECT x, y, count(*) AS n FROM ch GROUP BY ALL) SELECT CAST((SELECT sum(n) FROM p) AS BIGINT) AS symbols, (SELECT round({kt(v=27)}, 3) FROM (SELECT y, sum(n) AS n FROM p GROUP BY y)) AS bits0, (SELECT round(sum(b), 3) FROM (SELECT {kt(v=27)} AS b FROM p GROUP BY x)) AS bits1""",
    "case_histogram": f"WITH {_FORMS} SELECT * FROM cs",
    "token_streams": f"""WITH {_FORMS}, fc AS (SELECT count(*) AS f FROM fm WHERE kind <> 'other'), s1 AS (SELECT n FROM fm WHERE kind = 'other' UNION ALL SELECT n - 1 FROM fm WHERE kind <> 'other' AND n > 1 UNION ALL SELECT count(*) FROM fm WHERE kind <> 'other' GROUP BY kind UNION ALL SELECT 1),
 s2 AS (SELECT kind, ch, count(*) AS n FROM (SELECT kind, unnest(list_concat(regexp_extract_all(form, '.'), [''])) AS ch FROM fm WHERE kind <> 'other') GROUP BY ALL)
 SELECT 'S1' AS stream, count(*) AS types, CAST(sum(n) AS BIGINT) AS symbols, round((lgamma(sum(n) + (f + 259) / 2.0) - lgamma((f + 259) / 2.0) - sum(lgamma(n + 0.5) - lgamma(0.5))) / ln(2.0), 3) AS bits FROM s1, fc GROUP BY f
 UNION ALL SELECT 'S2a', count(*), CAST(sum(n) AS BIGINT), round({kt(v=27)}, 3) FROM s2 WHERE kind = 'word' UNION ALL SELECT 'S2b', count(*), CAST(sum(n) AS BIGINT), round({kt(v=11)}, 3) FROM s2 WHERE kind = 'number'
 UNION ALL SELECT 'S3', count(*), CAST(sum(n) AS BIGINT), round({kt(v=4)}, 3) FROM cs""",
    "tokenizer_roundtrip": r"""SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+')) + octet_length(encode(coalesce(text, ''))) - length(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', '', 'g')) + 1 AS INTEGER) AS tokens,
 CAST(len(list_distinct(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]', ' ', 'g')), '[a-z]+|[0-9]+'))) AS INTEGER) AS forms, true AS same FROM documents""",
    "stratified_estimate": """WITH v AS (SELECT kind, count(n_chars) AS k, avg(CAST(n_chars AS DOUBLE)) AS m, coalesce(var_samp(CAST(n_chars AS DOUBLE)), 0) AS v, count(*) AS s FROM documents GROUP BY kind HAVING count(n_chars) > 0),
 t AS (SELECT sum(s) AS p, sum(s * m) AS t, sqrt(sum(CAST(s AS DOUBLE) * s * (1 - k / s) * v / k)) AS sd FROM v) SELECT CAST(p AS BIGINT) AS population, round(t / p, 4) AS estimate, round(t, 4) AS total, round(sd / p, 4) AS standard_error, round(t / p - 1.96 * sd / p, 4) AS low, round(t / p + 1.96 * sd / p, 4) AS high FROM t""",
    "lag_information": f"WITH {_LAGINFO} SELECT lag, round(bits, 6) AS bits FROM li",
    "lag_decay_fit": f"WITH {_LAGINFO} SELECT round(regr_slope(ln(bits), ln(lag)), 5) AS power_slope, round(exp(regr_intercept(ln(bits), ln(lag))), 5) AS power_scale, round(regr_slope(ln(bits), lag), 5) AS exp_slope, round(exp(regr_intercept(ln(bits), lag)), 5) AS exp_scale FROM li WHERE bits > 0",
    "event_pairs": "SELECT y, x1, count(*) AS n FROM (SELECT event_type AS y, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x1 FROM events) WHERE x1 IS NOT NULL GROUP BY ALL",
    "event_contexts": "SELECT y, x1, x2, count(*) AS n FROM (SELECT event_type AS y, lag(event_type) OVER w AS x1, lag(event_type, 2) OVER w AS x2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE x2 IS NOT NULL GROUP BY ALL",
    "order_status_pairs": "SELECT y, x1, count(*) AS n FROM (SELECT o_orderstatus AS y, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS x1 FROM orders) WHERE x1 IS NOT NULL GROUP BY ALL",
    "returnflag_pairs": "SELECT y, x1, count(*) AS n FROM (SELECT l_returnflag AS y, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS x1 FROM lineitem) WHERE x1 IS NOT NULL GROUP BY ALL",
    "global_pair_counts": f"WITH {TOK} SELECT y, x1, count(*) AS n FROM (SELECT sym AS y, lag(sym) OVER (ORDER BY doc_id, pos) AS x1 FROM tok) WHERE x1 IS NOT NULL GROUP BY ALL",
    "streaming_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "streaming_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
