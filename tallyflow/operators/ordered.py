"""History of rows in a total order, without a task that holds a whole sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.operators import counting
from tallyflow.sources.tables import cut


#: Rows of a chunk, about.
CHUNK_ROWS = 2_000_000


def lagged_rows(rows: DataFrame, sequence: list[str], order: list[str], symbol: str, lags: int) -> DataFrame:
    """``sequence.., order.., y, x1..x<lags>``: each row's symbol with the ones before it in its sequence.

    With ``sequence`` empty all rows are one sequence. ``order`` must be total within a sequence; nulls come
    first. History that is missing is null.

    Rows are range partitioned by (sequence, order) and written once; a sequence that holds a third of
    all rows spreads over as many chunks as it needs. Neighbours are looked up inside a chunk; the last
    ``lags`` rows of each chunk (a few rows a chunk) go through the driver to the chunk after it.
    """
    spark = rows.sparkSession
    # A chunk is a task's window, so their number follows the rows: a count of a scanned table reads footers alone.
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // CHUNK_ROWS))
    keys = [*sequence, *order]
    flat = rows.select(*keys, F.col(symbol).alias("y"))
    fixed = cut(flat.repartitionByRange(chunks, *[F.col(k) for k in keys]).withColumn("_chunk", F.spark_partition_id()), "ordered")
    latest = W.partitionBy("_chunk").orderBy(*[F.desc_nulls_last(k) for k in keys])
    tails = fixed.withColumn("_back", F.row_number().over(latest)).filter(F.col("_back") <= lags).collect()
    per: dict[int, list] = {}
    for t in sorted(tails, key=lambda t: (t["_chunk"], -t["_back"])):
        per.setdefault(t["_chunk"], []).append(t)
    carried, held = [], []
    for c in sorted(per):
        carried += [tuple(t[k] for k in [*keys, "y"]) + (c, True, i) for i, t in enumerate(held)]
        held = (held + per[c])[-lags:]
    body = fixed.withColumn("_carry", F.lit(False)).withColumn("_no", F.lit(0))
    if carried:
        body = body.unionByName(spark.createDataFrame(carried, body.schema))
    before = W.partitionBy("_chunk").orderBy(F.desc("_carry"), "_no", *[F.asc_nulls_first(k) for k in keys])
    same = [F.lag(k, i).over(before).eqNullSafe(F.col(k)) for i in range(1, lags + 1) for k in sequence]
    out = {}
    for i in range(1, lags + 1):
        ok = F.lag(F.lit(1), i).over(before).isNotNull()
        for s in same[(i - 1) * len(sequence) : i * len(sequence)]:
            ok = ok & s
        out[f"x{i}"] = F.when(ok, F.lag("y", i).over(before))
    return body.withColumns(out).filter(~F.col("_carry")).drop("_chunk", "_carry", "_no")


def lagged_counts(rows: DataFrame, sequence: list[str], order: list[str], symbol: str, lags: int) -> DataFrame:
    """``y, x1.., n`` over the rows whose sequence has ``lags`` rows before them (symbols must not be null)."""
    names = [f"x{i}" for i in range(1, lags + 1)]
    return lagged_rows(rows, sequence, order, symbol, lags).filter(F.col(f"x{lags}").isNotNull()).groupBy("y", *names).agg(F.count("*").alias("n"))


def global_pair_counts(stream: DataFrame, key: str) -> DataFrame:
    """``y, x1, n`` of neighbours in the one sequence that the stream's sequences form in the order of ``key`` (unique).

    Inside a sequence neighbours are slices of its array; only its first and last symbol, a row a sequence, are
    put in order to find those across a border. Empty sequences are no border.
    """
    inside = counting.context_counts(stream, [1])
    ends = cut(stream.filter(F.size("syms") > 0).select(key, F.struct(F.col("syms")[0].alias("a"), F.element_at("syms", -1).alias("z")).alias("ends")), "ends")
    across = lagged_rows(ends, [], [key], "ends", 1).filter("x1 is not null").select(F.col("y.a").alias("y"), F.col("x1.z").alias("x1"))
    return counting.merge_counts(inside, across.groupBy("y", "x1").agg(F.count("*").alias("n")), ["y", "x1"])
