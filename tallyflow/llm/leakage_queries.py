"""Queries on evaluation texts that leak into the corpus (p7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyflow.llm.leakage import LEAK, label, leaks
from tallyflow.sources.tables import read_table

#: Cosine from which a passage is a candidate: for copied runs, and for paraphrases.
COPIED, PARAPHRASED = 0.99, 0.85


def found_leaks(spark: SparkSession, sf: str) -> DataFrame:
    pairs = leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "heldout_items"), COPIED, paraphrases=False)
    return pairs.filter(f"run >= {LEAK}").select("doc_id", "item_id")


def rated_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair with a similar passage: longest common run and subsequence, its share, telling words, and what it is."""
    return leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "heldout_items"), PARAPHRASED, paraphrases=True).withColumn("kind", label())


def copied_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The leaks with the number of words of their longest common run."""
    return leaks(read_table(spark, sf, "documents"), read_table(spark, sf, "heldout_items"), COPIED, paraphrases=False).select("doc_id", "item_id", "run")


QUERIES = {"p7_found": found_leaks, "p7_runs": copied_runs, "p7_rated": rated_leaks}

ORACLE = {
    "p7_found": """WITH w AS (SELECT doc_id AS id, 0 AS held, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT item_id, 1, regexp_extract_all(lower(text), '[a-z0-9]+') FROM heldout_items WHERE text IS NOT NULL),
 g AS (SELECT DISTINCT held, id, array_to_string(w[p : p + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS p FROM w WHERE len(w) >= 12))
 SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.g = i.g WHERE d.held = 0 AND i.held = 1""",
    "p7_runs": """WITH w AS (SELECT doc_id AS id, 0 AS held, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT item_id, 1, regexp_extract_all(lower(text), '[a-z0-9]+') FROM heldout_items WHERE text IS NOT NULL),
 g AS (SELECT held, id, p, array_to_string(w[p : p + 11], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 10)) AS p FROM w WHERE len(w) >= 12)),
 m AS (SELECT d.id AS doc_id, i.id AS item_id, d.p, d.p - i.p AS diagonal FROM g d JOIN g i ON d.g = i.g WHERE d.held = 0 AND i.held = 1),
 s AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS island FROM m)
 SELECT doc_id, item_id, CAST(max(n) + 11 AS INTEGER) AS run FROM (SELECT doc_id, item_id, count(*) AS n FROM s GROUP BY doc_id, item_id, diagonal, island) GROUP BY doc_id, item_id""",
}
