"""Counts that grow with a stream of files, and event-time windows.

``incremental_counts`` adds each micro-batch to what was counted before; its state is a written table a
batch, and a batch that is replayed after a failure replaces its own table, so counts stay exact.
Event-time windows are an extension on top of position-based streams.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.sources.tables import work_dir


def _stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a table (one file or a folder)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch)
    if files.getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def _drain(stream: DataFrame, spark: SparkSession, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    where = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def incremental_counts(spark: SparkSession, path: str, keys: list[str], files_a_batch: int = 1) -> DataFrame:
    """``keys.., n`` over all files, counted batch by batch."""
    base = f"{work_dir(spark)}/counts-{uuid.uuid4().hex}"

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/batch={number}")

    _drain(_stream(spark, path, files_a_batch), spark, add)
    return spark.read.parquet(base).groupBy(*keys).agg(F.sum("n").alias("n"))


def windowed_counts(spark: SparkSession, path: str, time: str, key: str, width: str = "1 day", late: str | None = None) -> DataFrame:
    """``start, key, n``: tumbling windows of event time by a stateful aggregation.

    Update mode writes a window whenever it changes; of its versions the largest count holds. Every record counts,
    however late, and the state is a row per window and key; with ``late`` a watermark bounds the state instead,
    and the engine drops records that are later than that.
    """
    base = f"{work_dir(spark)}/windows-{uuid.uuid4().hex}"
    timed = _stream(spark, path).withColumn(time, F.col(time).cast("timestamp"))
    windows = (timed.withWatermark(time, late) if late else timed).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    counted = windows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={number}")

    _drain(counted, spark, keep, "update")
    return spark.read.parquet(base).groupBy("start", key).agg(F.max("n").alias("n"))


def causal_scores(spark: SparkSession, path: str, key: str, files_a_batch: int = 1) -> DataFrame:
    """``batch, records, bits``: each batch's symbols coded by the counts of the batches before it, then merged.

    Law of a symbol: (c + 1/2) / (n + (k + 1) / 2) with c, n, k the earlier count, total and distinct symbols.
    """
    base = f"{work_dir(spark)}/causal-{uuid.uuid4().hex}"

    def score(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = batch.groupBy(key).agg(F.count("*").alias("n"))
        if number == 0:
            old = session.createDataFrame([], f"{key} string, c bigint")
        else:
            old = session.read.parquet(f"{base}/counts").filter(F.col("batch") < number).groupBy(key).agg(F.sum("n").alias("c"))
        totals = old.agg(F.struct(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("k")).alias("t"))
        law = (F.coalesce("c", F.lit(0)) + 0.5) / (F.col("t.n") + (F.col("t.k") + 1) / 2.0)
        scored = new.join(old, key, "left").withColumn("t", totals.scalar()).agg(F.sum("n").alias("records"), F.sum(-F.col("n") * F.log2(law)).alias("bits"))
        scored.write.mode("overwrite").parquet(f"{base}/scores/batch={number}")
        new.write.mode("overwrite").parquet(f"{base}/counts/batch={number}")

    _drain(_stream(spark, path, files_a_batch), spark, score)
    return spark.read.parquet(f"{base}/scores").select("batch", "records", "bits")
