"""Queries on filling containers (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.bin_packing import check_packing, container_loads, pack
from tallyflow.sources.tables import read_table


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs (valid version: memory and workers) and tasks (work) with the capacities of their pools."""
    jobs = read_table(spark, sf, "checkpoint_jobs").filter("job_id is not null").groupBy("job_id").agg(F.max(F.struct("updated_at", "private_memory_bytes", "workers", "pool")).alias("v"))
    tasks = read_table(spark, sf, "moldable_tasks").filter("task_id is not null").groupBy("task_id").agg(F.max(F.struct("created_at", "work", "pool")).alias("v"))
    both = jobs.select(F.lit("job").alias("kind"), F.col("job_id").alias("item_id"), "v.pool", F.col("v.private_memory_bytes").cast("double").alias("size"), F.col("v.workers").cast("double").alias("second")).unionByName(
        tasks.select(F.lit("task").alias("kind"), F.col("task_id").alias("item_id"), "v.pool", F.col("v.work").alias("size"), F.lit(None).cast("double").alias("second"))
    )
    room = read_table(spark, sf, "capacities").groupBy("pool").agg(F.max("capacity_bytes").alias("bytes"), F.max("max_workers").alias("most"), F.max("work_units").alias("units"))
    job = F.col("kind") == "job"
    return both.join(room, "pool", "left").select(
        "kind", "item_id", "pool", "size", "second",
        F.when(job, F.col("bytes").cast("double")).otherwise(F.col("units")).alias("capacity"), F.when(job, F.col("most").cast("double")).alias("second_capacity"),
    )


def packed(spark: SparkSession, sf: str) -> DataFrame:
    return pack(items(spark, sf))


def placements(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf).select("kind", "item_id", "pool", "size", "second", "status", "container")


def found_oversize(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf).filter("status = 'oversize'").select("kind", "item_id")


QUERIES = {"p3_found": found_oversize, "p3_containers": placements, "p3_loads": lambda s, d: container_loads(packed(s, d)), "p3_check": lambda s, d: check_packing(packed(s, d))}

ORACLE = {
    "p3_found": """SELECT 'job' AS kind, job_id AS item_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST) AS v FROM checkpoint_jobs WHERE job_id IS NOT NULL) j
  JOIN capacities c ON c.pool = j.pool WHERE v = 1 AND (private_memory_bytes > capacity_bytes OR workers > max_workers)
 UNION ALL SELECT DISTINCT 'task', task_id FROM moldable_tasks t JOIN capacities c ON c.pool = t.pool WHERE work > work_units""",
    "p3_check": """WITH j AS (SELECT 'job' AS kind, j.pool, private_memory_bytes > capacity_bytes OR workers > max_workers AS over, c.pool IS NULL AS none FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST) AS v FROM checkpoint_jobs WHERE job_id IS NOT NULL) j LEFT JOIN capacities c ON c.pool = j.pool WHERE v = 1),
 t AS (SELECT 'task' AS kind, t.pool, work > work_units AS over, c.pool IS NULL AS none FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY created_at DESC NULLS LAST) AS v FROM moldable_tasks WHERE task_id IS NOT NULL) t LEFT JOIN capacities c ON c.pool = t.pool WHERE v = 1)
 SELECT kind, pool, count(*) AS items, count(*) FILTER (NOT (none OR coalesce(over, false))) AS placed, count(*) FILTER (none OR coalesce(over, false)) AS unplaced, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS overfull FROM (SELECT * FROM j UNION ALL SELECT * FROM t) GROUP BY ALL""",
}
