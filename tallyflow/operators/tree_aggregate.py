"""Per-key results under heavy skew: local combination, then merging in rounds of bounded fan-in."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.sources.tables import cut

#: How the state of each kind of aggregate is made from rows and from other states.
_FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}


def distinct_records(df: DataFrame, record_id: str, columns: Mapping[str, Column]) -> DataFrame:
    """One row per non-null ``record_id``; of copies that differ the smallest one holds as a whole.

    Copies are compared by the columns in their order. A single column of fixed width stays in the hash
    operator, which spills to sorted runs when it outgrows its memory; ask for no more columns than needed.
    """
    named = df.filter(F.col(record_id).isNotNull()).select(F.col(record_id).alias("_id"), *[c.alias(k) for k, c in columns.items()])
    if len(columns) == 1:
        return named.groupBy("_id").agg(*[F.min(k).alias(k) for k in columns])
    return named.groupBy("_id").agg(F.min(F.struct(*columns)).alias("_r")).select("_id", "_r.*")


def partitions_of(df: DataFrame) -> int:
    """An upper bound of the partitions that ``df`` runs in.

    Behind an exchange that is the session's number of shuffle partitions or the number asked for; a plan
    without one has as many as its scans give.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" not in plan.toString():
        return df._jdf.queryExecution().toRdd().getNumPartitions()
    asked = [int(n) for n in re.findall(r"partitioning\([^\n]*?(\d+)\), (?:REPARTITION_BY_NUM|ENSURE_REQUIREMENTS|REPARTITION_BY_COL)", plan.toString())]
    return max([int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *asked])


def tree_aggregate(df: DataFrame, key: str, aggregates: Mapping[str, tuple[str, str]], fan_in: int = 16, chunks: int | None = None) -> DataFrame:
    """Aggregate by ``key`` so that no task receives more than ``fan_in`` partial states of one key.

    Every partition of the input is a chunk, combined where it lies: the rows of the heaviest key
    become one state per chunk before anything moves. A round merges the states of ``fan_in``
    neighbouring chunks, keyed by (key, group of chunks), and so on until one group is left: the
    logarithm of the number of chunks, to the base ``fan_in``, rounds in all.

    aggregates: result column -> (``count``|``sum``|``min``|``max``, input column). A null key is a key of
    its own; nulls of an input column are passed over, as in SQL. An empty table gives no rows.
    Result: ``key`` and the result columns. Columns of the input that are not named are dropped
    first, so clashing extra names do no harm.
    """
    chunks = chunks or partitions_of(df)
    inputs = dict.fromkeys(c for _, c in aggregates.values())
    state = df.select(F.col(key).alias("_key"), F.spark_partition_id().alias("_chunk"), *[F.col(c).alias(f"_in_{c}") for c in inputs])
    first, span = True, 1
    while first or span < chunks:
        span *= fan_in
        if span >= chunks:
            group = []
        else:
            group = [F.floor(F.col("_chunk") / fan_in).cast("int").alias("_chunk")]
        outs = [((_FIRST if first else _MERGE)[how])(F.col(f"_in_{c}" if first else f"_s_{name}")).alias(f"_s_{name}") for name, (how, c) in aggregates.items()]
        state = state.groupBy("_key", *group).agg(*outs)
        first = False
    return state.select(F.col("_key").alias(key), *[F.col(f"_s_{n}").alias(n) for n in aggregates])


def heavy_keys(per_key: DataFrame, key: str, weight: str, share_percent: int, include_null: bool = False) -> DataFrame:
    """The keys with at least ``share_percent`` % of the whole weight, with ``share`` as a double.

    The per-key rows are written once, since the whole and the comparison both read them. With
    ``include_null`` the null key counts towards the whole, but it is never named as heavy.
    """
    per_key = cut(per_key, "keys")
    counted = per_key if include_null else per_key.filter(F.col(key).isNotNull())
    whole = counted.agg(F.sum(weight).alias("w"))
    marked = per_key.filter(F.col(key).isNotNull()).withColumn("_w", whole.scalar())
    return marked.filter(F.col(weight) * 100 >= F.col("_w") * share_percent).withColumn("share", F.col(weight) / F.col("_w")).drop("_w")
