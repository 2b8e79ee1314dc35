"""Ranked and capped vocabularies, and what capping hides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyflow.sources.streams import positions


#: A vocabulary of up to so many rows is broadcast (a few MB at the length of words).
BROADCAST_ROWS = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def top_symbols(stream: DataFrame, k: int, key: str) -> DataFrame:
    """``sym, n, rank``: the k most frequent symbols, ranked from 0; ties go to the earlier first occurrence.

    The order is total (count, then first (key, position)); ``limit`` after ``orderBy`` keeps k rows per
    task, so ranking sees k rows, however large the vocabulary.
    """
    rows = positions(stream, key)
    counted = rows.groupBy("sym").agg(F.count("*").alias("n"), F.min(F.struct(key, "pos")).alias("first"))
    kept = counted.orderBy(F.desc("n"), "first").limit(k)
    return kept.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "first")) - 1).select("sym", "n", "rank")


def capped(counts: DataFrame, vocabulary: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Counts with the symbols of ``columns`` replaced by their rank, those outside the vocabulary by k.

    The vocabulary has at most k rows and is broadcast up to BROADCAST_ROWS of them; beyond that Spark picks
    the join by size. Counts are relabelled after they were made, thus a row per distinct cell is joined and
    not a row per position.
    """
    out = counts
    for c in columns:
        names = vocabulary.select(F.col("sym").alias(f"_{c}"), F.col("rank").alias(f"_r_{c}"))
        out = out.join(_small(names, k), out[c].eqNullSafe(names[f"_{c}"]), "left").withColumn(c, F.coalesce(f"_r_{c}", F.lit(k)).cast("int")).drop(f"_{c}", f"_r_{c}")
    return out.groupBy(*[c for c in counts.columns if c != "n"]).agg(F.sum("n").alias("n"))


def escape_payload(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``sym, n``: what the unknown symbol stands for."""
    return counts.join(vocabulary.select("sym"), "sym", "left_anti")


def order_by_id(vocabulary: DataFrame) -> DataFrame:
    """``sym, n, rank, id_rank``: the promotion order by ascending symbol, which doesn't depend on counts."""
    return vocabulary.withColumn("id_rank", F.row_number().over(W.orderBy("sym")) - 1)


def first_occurrences(stream: DataFrame, key: str, pattern: str = "^[A-Za-z]+$") -> DataFrame:
    """``sym, first_key, first_pos``: where each symbol that matches occurs first."""
    rows = positions(stream, key).filter(F.col("sym").rlike(pattern))
    return rows.groupBy("sym").agg(F.min(F.struct(key, "pos")).alias("f")).select("sym", F.col(f"f.{key}").alias("first_key"), F.col("f.pos").alias("first_pos"))
