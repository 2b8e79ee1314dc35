"""Queries on the frequency of terms (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.term_frequency import DIGITS, END, LETTERS, bands, one_per_record, run_frequencies
from tallyflow.sources.tables import read_table


#: The longest phrases reported.
PHRASE = 5


def _records(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    return one_per_record(read_table(spark, sf, "tokenized"), "segment_id", ("tokens", "vocabulary", *extra), "written_at")


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "tokenized").filter("tokens is not null").agg(F.countDistinct("segment_id").alias("w"))


def terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every term with its occurrences, its records and its bands (comma-separated)."""
    counted = run_frequencies(_records(spark, sf)).select(F.col("terms")[0].alias("term"), "occurrences", "records")
    marked = counted.withColumn("w", _whole(spark, sf).scalar())
    return marked.select("term", "occurrences", "records", F.array_join(bands(F.col("records"), F.col("w")), ",").alias("bands"))


def found_terms(spark: SparkSession, sf: str) -> DataFrame:
    return terms(spark, sf).filter("bands <> ''").select("term", F.explode(F.split("bands", ",")).alias("band"))


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of two to PHRASE terms that occur in at least two records."""
    return run_frequencies(_records(spark, sf), 2, PHRASE).filter("records > 1").select("n", F.array_join("terms", " ").alias("phrase"), "occurrences", "records")


def run_types(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct terms per run up to each checkpoint at which it has segments, beside results.distinct_types.

    ``agrees`` is null where nothing is stated. Of repeated results the smallest stated value holds.
    """
    rows = _records(spark, sf, "run_id", "checkpoint")
    live = F.when(F.array_contains("tokens", END), F.slice("tokens", 1, F.array_position("tokens", END).cast("int"))).otherwise(F.col("tokens"))
    marks = F.size(F.filter(live, lambda t: t.isin(LETTERS, DIGITS)))
    used = F.slice("vocabulary", F.lit(1), F.least(marks, F.size("vocabulary")))
    first = rows.filter("vocabulary is not null").select("run_id", "checkpoint", F.explode(used).alias("term")).filter("term is not null").groupBy("run_id", "term").agg(F.min("checkpoint").alias("checkpoint"))
    new = first.groupBy("run_id", "checkpoint").agg(F.count("*").alias("new_types"))
    stated = read_table(spark, sf, "results").groupBy("run_id", "checkpoint").agg(F.min("distinct_types").alias("stated"))
    # A run has a handful of checkpoints, so its window is a handful of rows.
    steps = rows.select("run_id", "checkpoint").distinct().join(new, ["run_id", "checkpoint"], "left")
    upto = F.expr("sum(coalesce(new_types, 0)) over (partition by run_id order by checkpoint)").alias("types")
    return steps.select("run_id", "checkpoint", upto).join(stated, ["run_id", "checkpoint"], "left").select("run_id", "checkpoint", "types", "stated", (F.col("types") == F.col("stated")).alias("agrees"))


QUERIES = {"p5_found": found_terms, "p5_terms": terms, "p5_phrases": phrases, "p5_types": run_types}

_OCCURRENCES = """WITH d AS (SELECT segment_id, run_id, checkpoint, tokens, vocabulary FROM tokenized WHERE tokens IS NOT NULL AND segment_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY segment_id ORDER BY written_at NULLS LAST) = 1),
 t AS (SELECT segment_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM d),
 k AS (SELECT *, count(*) FILTER (tok IN (256, 257)) OVER w AS k, count(*) FILTER (tok = 258) OVER w AS e FROM t WINDOW w AS (PARTITION BY segment_id ORDER BY pos)),
 m AS (SELECT segment_id, max(k) AS marks FROM k WHERE e = 0 GROUP BY ALL),
 o AS (SELECT k.segment_id, pos, d.vocabulary[(CASE WHEN tok IN (256, 257) THEN k ELSE tok - 258 END)] AS term FROM k JOIN m USING (segment_id) JOIN d USING (segment_id)
  WHERE e = 0 AND (tok IN (256, 257) OR tok >= 259 AND tok - 259 < marks)),
 f AS (SELECT term, count(*) AS occurrences, count(DISTINCT segment_id) AS records FROM o WHERE term IS NOT NULL GROUP BY term),
 b AS (SELECT *, (SELECT count(*) FROM d) AS w FROM f)"""

ORACLE = {
    "p5_found": f"{_OCCURRENCES} SELECT term, 'rare' AS band FROM b WHERE records <= 2 UNION ALL SELECT term, 'common' FROM b WHERE records * 2 >= w",
    "p5_terms": f"{_OCCURRENCES} SELECT term, occurrences, records, concat_ws(',', CASE WHEN records <= 2 THEN 'rare' END, CASE WHEN records * 2 >= w THEN 'common' END) AS bands FROM b",
    "p5_phrases": f"""{_OCCURRENCES}, q AS (SELECT segment_id, list(term ORDER BY pos) AS t FROM o WHERE term IS NOT NULL GROUP BY segment_id),
 g AS (SELECT segment_id, n, t[p : p + n - 1] AS l FROM (SELECT segment_id, t, n, unnest(range(1, len(t) - n + 2)) AS p FROM q, (SELECT CAST(unnest([2, 3, 4, 5]) AS INTEGER) AS n)))
 SELECT n, array_to_string(l, ' ') AS phrase, count(*) AS occurrences, count(DISTINCT segment_id) AS records FROM g GROUP BY n, l HAVING count(DISTINCT segment_id) > 1""",
    "p5_types": f"""{_OCCURRENCES}, s AS (SELECT DISTINCT run_id, checkpoint FROM d), u AS (SELECT d.run_id, o.term, min(d.checkpoint) AS checkpoint FROM o JOIN d USING (segment_id) WHERE term IS NOT NULL GROUP BY ALL),
 r AS (SELECT run_id, checkpoint, min(distinct_types) AS stated FROM results GROUP BY ALL)
 SELECT s.run_id, s.checkpoint, count(u.term) AS types, any_value(r.stated) AS stated, count(u.term) = any_value(r.stated) AS agrees FROM s LEFT JOIN u ON u.run_id = s.run_id AND u.checkpoint <= s.checkpoint
 LEFT JOIN r ON r.run_id = s.run_id AND r.checkpoint = s.checkpoint GROUP BY s.run_id, s.checkpoint""",
}
