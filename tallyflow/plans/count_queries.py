"""Queries on streams, vocabularies, counts and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators import counting, profiles, vocabulary
from tallyflow.plans.shared import GRID, K, RANKED, TOK, VOC, capped_pairs, capped_triples, tokens, vocab
from tallyflow.sources import streams
from tallyflow.sources.tables import read_table

#: The last block holds the rest of every text.
EDGES = [2, 64, 256, 1024, None]
LAST = len(EDGES) - 1
STOPS = [16, 128, 1024]


def _deltas(s: SparkSession, d: str) -> DataFrame:
    return counting.interval_counts(tokens(s, d), [1], EDGES)


def _upto(s: SparkSession, d: str) -> DataFrame:
    return counting.cumulative_counts(_deltas(s, d), ["y", "x1"], list(range(1, LAST + 1)))


def _audit(s: SparkSession, d: str) -> DataFrame:
    """Counts added up over blocks against counts made directly; no row means that they agree."""
    direct = counting.shifted(tokens(s, d), [1], 1).filter(F.col("pos") >= EDGES[0]).groupBy("y", "x1").agg(F.count("*").alias("n"))
    return counting.audit_counts(_upto(s, d).filter(F.col("checkpoint") == LAST), direct, ["y", "x1"])


def _merged(s: SparkSession, d: str) -> DataFrame:
    blocks = _deltas(s, d)
    return counting.merge_counts(blocks.filter("checkpoint = 1"), blocks.filter("checkpoint > 1"), ["y", "x1"])


def _unequal(s: SparkSession, d: str) -> DataFrame:
    return counting.mapped_counts(capped_triples(s, d), {"x1": 16, "x2": 4})


def _nested(s: SparkSession, d: str) -> DataFrame:
    from tallyflow.operators.families import state_members

    p = profiles.state_profiles(state_members(capped_pairs(s, d), GRID), ["m", "state"])
    return profiles.profile_multiset(p, ["m"]).select("m", profiles.spelled(F.col("profile")).alias("profile"), "states")


def _lag_profiles(s: SparkSession, d: str) -> DataFrame:
    p = profiles.state_classes(counting.lag_counts(tokens(s, d), [1, 2, 3]), ["lag", "x"])
    return profiles.profile_multiset(p, ["lag"]).groupBy("lag").agg(F.sum("states").alias("states"), F.count("*").alias("profiles"))


QUERIES = {
    "token_counts": lambda s, d: counting.symbol_counts(tokens(s, d)),
    "word_counts": lambda s, d: counting.symbol_counts(streams.words(read_table(s, d, "documents"))),
    "character_counts": lambda s, d: counting.symbol_counts(streams.characters(read_table(s, d, "documents"))),
    "byte_histogram": lambda s, d: streams.byte_histogram(read_table(s, d, "documents")),
    "stream_manifest": lambda s, d: streams.manifest(tokens(s, d), "segments"),
    "topk_vocab": vocab,
    "vocab_by_id": lambda s, d: vocabulary.order_by_id(vocab(s, d)),
    "capped_positions": lambda s, d: vocabulary.capped(counting.symbol_counts(tokens(s, d)), vocab(s, d), ["sym"], K),
    "reduced_stream_counts": capped_pairs,
    "escape_payload": lambda s, d: vocabulary.escape_payload(counting.symbol_counts(tokens(s, d)), vocab(s, d)),
    "prefix_counts": lambda s, d: counting.prefix_counts(tokens(s, d), STOPS),
    "pair_counts": lambda s, d: counting.context_counts(tokens(s, d), [1]),
    "lag_counts": lambda s, d: counting.lag_counts(tokens(s, d), [0, 1, 2, 4]),
    "context_nodes": lambda s, d: counting.context_nodes(capped_triples(s, d), 2),
    "count_delta": _deltas,
    "count_cumulative": _upto,
    "count_merge": _merged,
    "audit_counts": _audit,
    "unequal_delta": _unequal,
    "state_profiles": lambda s, d: profiles.state_profiles(capped_pairs(s, d), ["x1"]).select("x1", profiles.spelled(F.col("profile")).alias("profile"), "total"),
    "profile_multiset": lambda s, d: profiles.profile_multiset(profiles.state_classes(counting.context_counts(tokens(s, d), [1]), ["x1"])).select(F.md5(profiles.spelled_classes(F.col("profile"))).alias("profile"), "states"),
    "nested_profiles": _nested,
    "product_profiles": lambda s, d: profiles.profile_multiset(profiles.state_profiles(capped_triples(s, d), ["x1", "x2"])).select(profiles.spelled(F.col("profile")).alias("profile"), "states"),
    "lag_profiles": _lag_profiles,
    "class_sizes": lambda s, d: profiles.class_sizes(capped_pairs(s, d), ["x1"]),
}

_LAGGED = f"{TOK}, l AS (SELECT *, lag(sym) OVER w AS x1, lag(sym, 2) OVER w AS x2, lag(sym, 3) OVER w AS x3, lag(sym, 4) OVER w AS x4 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"
_BLOCKS = f"{_LAGGED}, b AS (SELECT CASE WHEN pos < 64 THEN 1 WHEN pos < 256 THEN 2 WHEN pos < 1024 THEN 3 ELSE 4 END AS checkpoint, sym AS y, x1, count(*) AS n FROM l WHERE pos >= 2 GROUP BY ALL)"

ORACLE = {
    "token_counts": f"WITH {TOK} SELECT sym, count(*) AS n FROM tok GROUP BY sym",
    "word_counts": r"SELECT sym, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+')) AS sym FROM documents WHERE text IS NOT NULL) WHERE sym <> '' GROUP BY sym",
    "character_counts": "SELECT sym, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS sym FROM documents WHERE text IS NOT NULL) GROUP BY sym",
    "byte_histogram": "WITH h AS (SELECT hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL AND text <> ''), b AS (SELECT ('0x' || substr(h, i * 2 + 1, 2))::INTEGER AS byte FROM (SELECT h, unnest(range(0, length(h) // 2)) AS i FROM h)) SELECT byte, count(*) AS n FROM b GROUP BY byte",
    "stream_manifest": f"WITH {TOK} SELECT 'segments' AS representation, count(*) AS n_symbols, count(DISTINCT sym) AS alphabet FROM tok",
    "topk_vocab": f"WITH {VOC} SELECT sym, n, CAST(rank AS INTEGER) AS rank FROM voc",
    "vocab_by_id": f"WITH {VOC} SELECT sym, n, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY sym) - 1 AS INTEGER) AS id_rank FROM voc",
    "capped_positions": f"WITH {RANKED} SELECT y AS sym, count(*) AS n FROM r GROUP BY y",
    "reduced_stream_counts": f"WITH {RANKED} SELECT * FROM pr",
    "escape_payload": f"WITH {VOC} SELECT sym, count(*) AS n FROM tok WHERE sym NOT IN (SELECT sym FROM voc) GROUP BY sym",
    "prefix_counts": f"WITH {TOK} SELECT stop, sym, count(*) AS n FROM tok JOIN (SELECT CAST(unnest([16, 128, 1024]) AS INTEGER) AS stop) ON pos < stop GROUP BY ALL",
    "pair_counts": f"WITH {_LAGGED} SELECT sym AS y, x1, count(*) AS n FROM l WHERE pos >= 1 GROUP BY ALL",
    "lag_counts": f"""WITH {_LAGGED} SELECT lag, x, y, count(*) AS n FROM (SELECT 0 AS lag, '' AS x, sym AS y FROM l WHERE pos >= 4 UNION ALL SELECT 1, x1, sym FROM l WHERE pos >= 4
 UNION ALL SELECT 2, x2, sym FROM l WHERE pos >= 4 UNION ALL SELECT 4, x4, sym FROM l WHERE pos >= 4) GROUP BY ALL""",
    "context_nodes": f"WITH {RANKED} SELECT CAST(2 - grouping(x1) - grouping(x2) AS INTEGER) AS d, x1, x2, y, CAST(sum(n) AS BIGINT) AS n FROM tr GROUP BY y, ROLLUP (x1, x2)",
    "count_delta": f"WITH {_BLOCKS} SELECT * FROM b",
    "count_cumulative": f"WITH {_BLOCKS} SELECT c.k AS checkpoint, y, x1, CAST(sum(n) AS BIGINT) AS n FROM b JOIN (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS k) c ON checkpoint <= c.k GROUP BY ALL",
    "count_merge": f"WITH {_BLOCKS} SELECT y, x1, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ALL",
    "audit_counts": f"WITH {_BLOCKS}, u AS (SELECT y, x1, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ALL), d AS (SELECT sym AS y, x1, count(*) AS n FROM l WHERE pos >= 2 GROUP BY ALL) SELECT coalesce(u.y, d.y) AS y, coalesce(u.x1, d.x1) AS x1, coalesce(u.n, 0) AS n_left, coalesce(d.n, 0) AS n_right FROM u FULL JOIN d ON u.y = d.y AND u.x1 = d.x1 WHERE coalesce(u.n, 0) <> coalesce(d.n, 0)",
    "unequal_delta": f"WITH {RANKED} SELECT y, least(x1, 16) AS x1, least(x2, 4) AS x2, CAST(sum(n) AS BIGINT) AS n FROM tr GROUP BY ALL",
    "state_profiles": f"WITH {RANKED} SELECT x1, string_agg(n::VARCHAR, ',' ORDER BY n DESC) AS profile, CAST(sum(n) AS BIGINT) AS total FROM pr GROUP BY x1",
    "profile_multiset": f"WITH {_LAGGED}, p AS (SELECT x1, sym, count(*) AS n FROM l WHERE pos >= 1 GROUP BY ALL), q AS (SELECT x1, string_agg(n::VARCHAR || ':' || k::VARCHAR, ',' ORDER BY n DESC) AS profile FROM (SELECT x1, n, count(*) AS k FROM p GROUP BY ALL) GROUP BY x1) SELECT md5(profile) AS profile, count(*) AS states FROM q GROUP BY profile",
    "nested_profiles": f"""WITH {RANKED}, g AS (SELECT m, least(x1, m) AS state, y, sum(n) AS n FROM pr, (SELECT CAST(unnest([0, 4, 16, 64]) AS INTEGER) AS m) GROUP BY ALL),
 q AS (SELECT m, state, string_agg(n::VARCHAR, ',' ORDER BY n DESC) AS profile FROM g GROUP BY ALL) SELECT m, profile, count(*) AS states FROM q GROUP BY ALL""",
    "product_profiles": f"WITH {RANKED}, q AS (SELECT x1, x2, string_agg(n::VARCHAR, ',' ORDER BY n DESC) AS profile FROM tr GROUP BY ALL) SELECT profile, count(*) AS states FROM q GROUP BY ALL",
    "lag_profiles": f"""WITH {_LAGGED}, a AS (SELECT 1 AS lag, x1 AS x, sym AS y FROM l WHERE pos >= 3 UNION ALL SELECT 2, x2, sym FROM l WHERE pos >= 3 UNION ALL SELECT 3, x3, sym FROM l WHERE pos >= 3),
 c AS (SELECT lag, x, y, count(*) AS n FROM a GROUP BY ALL), q AS (SELECT lag, x, string_agg(n::VARCHAR, ',' ORDER BY n DESC) AS profile FROM c GROUP BY ALL)
 SELECT lag, count(*) AS states, count(DISTINCT profile) AS profiles FROM q GROUP BY lag""",
    "class_sizes": f"WITH {RANKED} SELECT x1, n AS c, count(*) AS symbols FROM pr GROUP BY ALL",
}
