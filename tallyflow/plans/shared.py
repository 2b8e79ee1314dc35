"""What several groups of queries share: the capped token stream of documents, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyflow.operators import counting, vocabulary
from tallyflow.sources import streams
from tallyflow.sources.tables import cut, read_table

#: Kept symbols and the alphabet with the unknown symbol.
K = 64
V = K + 1
GRID = [0, 4, 16, 64]


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return streams.segments(read_table(spark, sf, "documents"))


def vocab(spark: SparkSession, sf: str, k: int = K) -> DataFrame:
    """The ranked top symbols: at most ``k`` rows, written once, since every capped column reads them."""
    return cut(vocabulary.top_symbols(tokens(spark, sf), k, "doc_id"), "vocab")


def capped_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``y, x1, n`` as ranks."""
    return vocabulary.capped(counting.context_counts(tokens(spark, sf), [1]), vocab(spark, sf), ["y", "x1"], K)


def capped_triples(spark: SparkSession, sf: str) -> DataFrame:
    """``y, x1, x2, n`` as ranks, over positions that have both lags."""
    return vocabulary.capped(counting.context_counts(tokens(spark, sf), [1, 2]), vocab(spark, sf), ["y", "x1", "x2"], K)


def capped_triples_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """The same over all positions that have a predecessor; where there is no second one, x2 is the unknown symbol."""
    return vocabulary.capped(counting.context_counts(tokens(spark, sf), [1, 2], 1), vocab(spark, sf), ["y", "x1", "x2"], K)


#: Common table expressions: tok (every position), voc (ranked top symbols), r (ranks per position), pr and tr (capped pairs and triples).
TOK = """tok AS (SELECT doc_id, unnest(t) AS sym, generate_subscripts(t, 1) - 1 AS pos FROM
 (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[0-9]+|[^A-Za-z0-9]') AS t FROM documents WHERE text IS NOT NULL))"""
VOC = f"""{TOK}, voc AS (SELECT sym, n, row_number() OVER (ORDER BY n DESC, f) - 1 AS rank FROM
 (SELECT sym, count(*) AS n, min(doc_id * 10000000 + pos) AS f FROM tok GROUP BY sym) QUALIFY row_number() OVER (ORDER BY n DESC, f) <= {K})"""
RANKED = f"""{VOC}, r AS (SELECT doc_id, pos, CAST(coalesce(rank, {K}) AS INTEGER) AS y FROM tok LEFT JOIN voc USING (sym)),
 l AS (SELECT *, lag(y) OVER w AS x1, lag(y, 2) OVER w AS x2 FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
 pr AS (SELECT y, x1, CAST(count(*) AS BIGINT) AS n FROM l WHERE x1 IS NOT NULL GROUP BY ALL),
 tr AS (SELECT y, x1, x2, CAST(count(*) AS BIGINT) AS n FROM l WHERE x2 IS NOT NULL GROUP BY ALL),
 tb AS (SELECT y, x1, CAST(coalesce(x2, {K}) AS INTEGER) AS x2, CAST(count(*) AS BIGINT) AS n FROM l WHERE x1 IS NOT NULL GROUP BY ALL)"""


def kt(n: str = "n", v: int = V) -> str:
    """SQL aggregate: KT bits of one state."""
    return f"(lgamma(sum({n}) + {v} / 2.0) - lgamma({v} / 2.0) - sum(lgamma({n} + 0.5) - lgamma(0.5))) / ln(2.0)"


def add_one(n: str = "n", v: int = V) -> str:
    return f"(lgamma(sum({n}) + {v}) - lgamma({v}) - sum(lgamma({n} + 1))) / ln(2.0)"
