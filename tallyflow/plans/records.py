"""Queries over skewed keys (p2) and drifting payloads (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.operators import schema_drift
from tallyflow.operators.tree_aggregate import distinct_records, heavy_keys, tree_aggregate
from tallyflow.sources.tables import cut, read_table

#: A key is heavy from this share of the records on.
HEAVY_PERCENT = 2


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Per context k1: distinct records, summed counts and the range of its ptr."""
    rows = distinct_records(read_table(spark, sf, "sparse_counts"), "count_id", {"k1": F.col("k1").cast("bigint"), "n": F.col("n"), "ptr": F.col("ptr")})
    return tree_aggregate(rows, "k1", {"records": ("count", "_id"), "n_sum": ("sum", "n"), "ptr_min": ("min", "ptr"), "ptr_max": ("max", "ptr")})


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Per profile_id: distinct contexts, summed observations and the range of depths."""
    rows = distinct_records(read_table(spark, sf, "context_profiles"), "ctx_id", {"profile_id": F.col("profile_id"), "n_obs": F.col("n_obs"), "depth": F.col("depth")})
    return tree_aggregate(rows, "profile_id", {"records": ("count", "_id"), "n_obs": ("sum", "n_obs"), "depth_min": ("min", "depth"), "depth_max": ("max", "depth")})


def found_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The heavy contexts and profiles, by their distinct records alone."""
    rows = distinct_records(read_table(spark, sf, "sparse_counts"), "count_id", {"k1": F.col("k1").cast("bigint")})
    ctx = heavy_keys(tree_aggregate(rows, "k1", {"records": ("count", "_id")}), "k1", "records", HEAVY_PERCENT, include_null=True)
    rows = distinct_records(read_table(spark, sf, "context_profiles"), "ctx_id", {"profile_id": F.col("profile_id")})
    prof = heavy_keys(tree_aggregate(rows, "profile_id", {"records": ("count", "_id")}), "profile_id", "records", HEAVY_PERCENT)
    return ctx.select(F.lit("context").alias("kind"), F.col("k1").alias("key_value")).unionByName(prof.select(F.lit("profile").alias("kind"), F.col("profile_id").alias("key_value")))


def found_changes(spark: SparkSession, sf: str) -> DataFrame:
    return schema_drift.drift_report(read_table(spark, sf, "result_files"))


def change_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each change happened, over all series."""
    return found_changes(spark, sf).groupBy("change_kind", "field_before", "field_after").agg(F.count("*").alias("changes"), F.countDistinct("series_id").alias("series"))


QUERIES = {
    "p2_found": found_keys,
    "p2_contexts": contexts,
    "p2_profiles": profiles,
    "p4_found": found_changes,
    "p4_changes": change_counts,
    "p4_schema": lambda s, d: schema_drift.fused_schema(read_table(s, d, "result_files")),
    "p4_table": lambda s, d: schema_drift.consistent_table(read_table(s, d, "result_files")),
    "p4_wide": lambda s, d: schema_drift.wide_table(cut(schema_drift.consistent_table(read_table(s, d, "result_files")), "table")),
}

_CONTEXTS = """SELECT k1, count(*) AS records, CAST(sum(n) AS BIGINT) AS n_sum, min(ptr) AS ptr_min, max(ptr) AS ptr_max FROM
 (SELECT count_id, min(CAST(k1 AS BIGINT)) AS k1, min(n) AS n, min(ptr) AS ptr FROM sparse_counts WHERE count_id IS NOT NULL GROUP BY count_id) GROUP BY k1"""
_PROFILES = """SELECT profile_id, count(*) AS records, CAST(sum(n_obs) AS BIGINT) AS n_obs, min(depth) AS depth_min, max(depth) AS depth_max FROM
 (SELECT ctx_id, min(profile_id) AS profile_id, min(n_obs) AS n_obs, min(depth) AS depth FROM context_profiles WHERE ctx_id IS NOT NULL GROUP BY ctx_id) GROUP BY profile_id"""

_LEAVES = """WITH RECURSIVE f AS (SELECT file_id, series_id, written_at, payload FROM result_files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY received_at NULLS LAST) = 1),
 rd AS (SELECT file_id, series_id, payload, written_at AT TIME ZONE 'UTC' AS written_at, row_number() OVER (PARTITION BY series_id ORDER BY written_at NULLS FIRST, file_id) AS k FROM f WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END),
 lv AS (SELECT rd.file_id, rd.series_id, rd.written_at, rd.k, replace(substr(j.fullkey, 3), '"', '') AS path, CASE WHEN j.type IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN j.type = 'DOUBLE' THEN 'decimal' WHEN j.type = 'VARCHAR' THEN 'text' WHEN j.type = 'BOOLEAN' THEN 'flag' WHEN j.type = 'ARRAY' THEN 'list' ELSE 'null' END AS tag,
  CASE WHEN j.type = 'ARRAY' THEN j.value ELSE j.atom END AS v FROM rd, json_tree(rd.payload::JSON) j WHERE j.fullkey <> '$' AND j.type <> 'OBJECT' AND j.fullkey NOT LIKE '%[%'),
 -- A stretch is a run of files of a series that all have the path; within it the last value that isn't null holds.
 st AS (SELECT *, k - row_number() OVER (PARTITION BY series_id, path ORDER BY k) AS stretch FROM lv),
 hd AS (SELECT *, last_value(CASE WHEN tag <> 'null' THEN tag END IGNORE NULLS) OVER w AS held, last_value(CASE WHEN tag <> 'null' THEN v END IGNORE NULLS) OVER w AS held_v,
  lag(file_id) OVER (PARTITION BY series_id, path, stretch ORDER BY k) IS NOT NULL AS stays, lead(file_id) OVER (PARTITION BY series_id, path, stretch ORDER BY k) IS NOT NULL AS goes_on
  FROM st WINDOW w AS (PARTITION BY series_id, path, stretch ORDER BY k ROWS UNBOUNDED PRECEDING)),
 gone AS (SELECT hd.series_id, n.file_id, n.k, hd.path, hd.held, hd.held_v FROM hd JOIN rd n ON n.series_id IS NOT DISTINCT FROM hd.series_id AND n.k = hd.k + 1 WHERE NOT goes_on),
 fresh AS (SELECT series_id, file_id, k, path, tag, v FROM hd WHERE NOT stays AND k > 1),
 cand AS (SELECT g.series_id, g.file_id, g.k, g.path AS b, n.path AS a, abs(CAST(g.held_v AS DOUBLE) - CAST(n.v AS DOUBLE)) / nullif(abs(CAST(g.held_v AS DOUBLE)), 0) AS off FROM gone g JOIN fresh n ON n.file_id = g.file_id AND n.tag = g.held AND n.tag IN ('integer', 'decimal')
  WHERE abs(CAST(g.held_v AS DOUBLE) - CAST(n.v AS DOUBLE)) <= 0.01 * abs(CAST(g.held_v AS DOUBLE))),
 rn AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.file_id = c.file_id AND (o.a = c.a OR o.b = c.b) AND (coalesce(o.off, 0), o.b, o.a) < (coalesce(c.off, 0), c.b, c.a))),
 ch AS (SELECT series_id, file_id, 'renamed' AS change_kind, b AS field_before, a AS field_after FROM rn
  UNION ALL SELECT series_id, file_id, 'removed', path, '' FROM gone g WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.file_id = g.file_id AND rn.b = g.path)
  UNION ALL SELECT series_id, file_id, 'added', '', path FROM fresh n WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.file_id = n.file_id AND rn.a = n.path)
  UNION ALL SELECT series_id, file_id, 'retyped', path, path FROM (SELECT *, lag(held) OVER (PARTITION BY series_id, path, stretch ORDER BY k) AS was FROM hd) WHERE tag <> 'null' AND was IS NOT NULL AND was <> tag)"""
# Stretches that begin by a rename go on under the name of the stretch they came from.
_FIELDS = """, sp AS (SELECT series_id, path, stretch, min(k) AS k0, max(k) AS k1 FROM st GROUP BY ALL),
 nm AS (SELECT sp.*, sp.path AS field FROM sp LEFT JOIN rn ON rn.series_id IS NOT DISTINCT FROM sp.series_id AND rn.k = sp.k0 AND rn.a = sp.path WHERE rn.b IS NULL
  UNION ALL SELECT sp.*, nm.field FROM nm JOIN rn ON rn.series_id IS NOT DISTINCT FROM nm.series_id AND rn.b = nm.path AND rn.k = nm.k1 + 1 JOIN sp ON sp.series_id IS NOT DISTINCT FROM rn.series_id AND sp.path = rn.a AND sp.k0 = rn.k)"""

ORACLE = {
    "p2_contexts": _CONTEXTS,
    "p2_profiles": _PROFILES,
    "p2_found": f"""WITH c AS ({_CONTEXTS}), p AS ({_PROFILES})
 SELECT 'context' AS kind, k1 AS key_value FROM c WHERE k1 IS NOT NULL AND records * 100 >= 2 * (SELECT sum(records) FROM c)
 UNION ALL SELECT 'profile', profile_id FROM p WHERE profile_id IS NOT NULL AND records * 100 >= 2 * (SELECT sum(records) FROM p WHERE profile_id IS NOT NULL)""",
    "p4_found": f"{_LEAVES} SELECT * FROM ch",
    "p4_changes": f"{_LEAVES} SELECT change_kind, field_before, field_after, count(*) AS changes, count(DISTINCT series_id) AS series FROM ch GROUP BY ALL",
    "p4_schema": f"""{_LEAVES}, t AS (SELECT path, list_sort(list(DISTINCT tag)) AS alternatives, list_filter(list_sort(list(DISTINCT tag)), lambda x: x <> 'null') AS kinds FROM lv GROUP BY path)
 SELECT lv.path, tag, count(*) AS files, min(written_at) AS first_seen, max(written_at) AS last_seen, any_value(alternatives) AS alternatives,
 CASE WHEN len(any_value(kinds)) = 0 THEN 'null' WHEN len(any_value(kinds)) = 1 THEN any_value(kinds)[1] WHEN any_value(kinds) = ['decimal', 'integer'] THEN 'decimal' ELSE 'text' END AS canonical FROM lv JOIN t ON t.path = lv.path GROUP BY lv.path, tag""",
    "p4_table": f"""{_LEAVES}{_FIELDS} SELECT st.series_id, st.file_id, st.written_at, nm.field, st.path, tag, CASE WHEN tag = 'list' THEN replace(v ->> '$', ',', ', ') WHEN tag = 'decimal' THEN regexp_extract(payload, '"' || regexp_extract(st.path, '[^.]*$') || '"\\s*:\\s*(-?[0-9.]+([eE][-+]?[0-9]+)?)', 1) ELSE v ->> '$' END AS lexeme, CASE WHEN tag = 'integer' THEN TRY_CAST(v AS BIGINT) END AS as_integer, CASE WHEN tag = 'decimal' THEN CAST(v AS DOUBLE) END AS as_decimal,
 CASE WHEN tag = 'flag' THEN CAST(v AS BOOLEAN) END AS as_flag, CASE WHEN tag = 'text' THEN v ->> '$' END AS as_text, CASE WHEN tag = 'list' THEN replace(v ->> '$', ',', ', ') END AS as_list,
 CASE WHEN tag IN ('integer', 'decimal', 'text') THEN TRY_CAST(v ->> '$' AS DOUBLE) WHEN tag = 'flag' THEN CASE WHEN CAST(v AS BOOLEAN) THEN 1.0 ELSE 0.0 END WHEN tag = 'list' AND json_array_length(v) = 1 THEN TRY_CAST(v ->> '$[0]' AS DOUBLE) END AS canonical_number
 FROM st JOIN nm ON nm.series_id IS NOT DISTINCT FROM st.series_id AND nm.path = st.path AND nm.stretch = st.stretch JOIN rd ON rd.file_id = st.file_id""",
}
