"""Counts of symbols, pairs and contexts.

Every count is made from the arrays of a stream by shifting slices against each other: one scan, one
exchange of map-side partial counts. Coarser tables (capped vocabularies, states, nested resolutions)
are made from these counts, never from the stream again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.sources.streams import positions


def shifted(stream: DataFrame, lags: list[int], start: int, *keep: str) -> DataFrame:
    """One row per position ``pos >= start``: ``keep.., pos, y`` and ``x1, x2, ..`` the symbols at ``lags`` back.

    Sequences are separate (history never crosses from one into the next); those of ``start`` or fewer
    symbols give no row. Where a lag is larger than ``start``, history that is missing is null.
    """
    length = F.size("syms") - start
    before = lambda d: F.concat(F.array_repeat(F.lit(None).cast("string"), d - start), F.slice("syms", F.lit(1), F.greatest(F.lit(0), length - (d - start))))
    piece = lambda d: F.slice("syms", F.lit(start + 1 - d), length) if d <= start else F.slice(before(d), F.lit(1), length)
    zipped = F.arrays_zip(F.sequence(F.lit(start), F.size("syms") - 1).alias("pos"), piece(0).alias("y"), *[piece(d).alias(f"x{i}") for i, d in enumerate(lags, 1)])
    # Short sequences give one row of nulls, dropped below; a filter on the array would split every text twice.
    rows = stream.select(*keep, F.inline_outer(F.when(length > 0, zipped)))
    names = [*keep, "pos", "y", *[f"x{i}" for i in range(1, len(lags) + 1)]]
    return rows.toDF(*names).filter(F.col("pos").isNotNull())


def symbol_counts(stream: DataFrame) -> DataFrame:
    """``sym, n``."""
    return positions(stream).groupBy("sym").agg(F.count("*").alias("n"))


def context_counts(stream: DataFrame, lags: list[int], start: int | None = None) -> DataFrame:
    """``y, x1.., n`` over positions that have all the history (or from ``start`` on)."""
    rows = shifted(stream, lags, max(lags, default=0) if start is None else start)
    return rows.groupBy("y", *[f"x{i}" for i in range(1, len(lags) + 1)]).agg(F.count("*").alias("n"))


def lag_counts(stream: DataFrame, lags: list[int]) -> DataFrame:
    """``lag, x, y, n`` for each lag, all over the positions that have the longest one; lag 0 has no state.

    One scan: each position gives a row per lag before counting.
    """
    real = [d for d in lags if d]
    rows = shifted(stream, real, max(real))
    states = [F.struct(F.lit(d).alias("lag"), F.col(f"x{i}").alias("x")) for i, d in enumerate(real, 1)]
    if 0 in lags:
        states.append(F.struct(F.lit(0).alias("lag"), F.lit("").alias("x")))
    return rows.select("y", F.explode(F.array(*states)).alias("s")).groupBy("s.lag", "s.x", "y").agg(F.count("*").alias("n"))


def context_nodes(counts: DataFrame, depth: int) -> DataFrame:
    """``d, x1.., y, n``: successor counts of every context of length 0 to ``depth``, nearest symbol first.

    From the counts of the longest contexts by rollup: shorter ones are sums of longer ones. Symbols
    beyond a context's length are null.
    """
    names = [f"x{i}" for i in range(1, depth + 1)]
    flat = counts.select("y", "n", *names)
    sets = [F.struct(F.lit(d).alias("d"), *[(F.col(x) if i < d else F.lit(None)).alias(x) for i, x in enumerate(names)]) for d in range(depth + 1)]
    each = flat.select("y", "n", F.explode(F.array(*sets)).alias("c")).select("y", "n", "c.*")
    return each.groupBy("d", *names, "y").agg(F.sum("n").alias("n"))


def interval_counts(stream: DataFrame, lags: list[int], edges: list[int | None]) -> DataFrame:
    """``checkpoint, y, x1.., n``: counts per block of positions; block k is [edges[k-1], edges[k]).

    Positions before the largest lag have no history and are not counted; those from the last edge on
    aren't either, unless that is None, the end of every sequence.
    """
    block = F.lit(None).cast("int")
    for k in range(len(edges) - 1, 0, -1):
        inside = F.col("pos") >= edges[k - 1]
        block = F.when(inside if edges[k] is None else inside & (F.col("pos") < edges[k]), k).otherwise(block)
    rows = shifted(stream, lags, max(lags)).withColumn("checkpoint", block).filter("checkpoint is not null")
    return rows.groupBy("checkpoint", "y", *[f"x{i}" for i in range(1, len(lags) + 1)]).agg(F.count("*").alias("n"))


def cumulative_counts(deltas: DataFrame, keys: list[str], checkpoints: list[int]) -> DataFrame:
    """``checkpoint, keys.., n``: counts up to and including each checkpoint, cells without counts left out.

    Increases are additive, so each row goes to every later checkpoint before one aggregation; a cell
    is never collected into an ordered group.
    """
    later = F.filter(F.array(*map(F.lit, checkpoints)), lambda c: c >= F.col("checkpoint"))
    return deltas.select(F.explode(later).alias("checkpoint"), *keys, "n").groupBy("checkpoint", *keys).agg(F.sum("n").alias("n"))


def merge_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``keys.., n``: two count tables added."""
    return left.select(*keys, "n").unionByName(right.select(*keys, "n")).groupBy(*keys).agg(F.sum("n").alias("n"))


def audit_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The cells in which two count tables differ: ``keys.., n_left, n_right`` (empty if they agree).

    Both are summed per cell in one aggregation; a cell that one table lacks counts 0 there.
    """
    both = left.select(*keys, F.col("n").alias("l"), F.lit(0).cast("bigint").alias("r")).unionByName(right.select(*keys, F.lit(0).cast("bigint").alias("l"), F.col("n").alias("r")))
    return both.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).filter("n_left <> n_right")


def prefix_counts(stream: DataFrame, stops: list[int]) -> DataFrame:
    """``stop, sym, n``: symbol counts of the first ``stop`` positions of every sequence, for each stop."""
    rows = positions(stream)
    in_prefix = F.filter(F.array(*map(F.lit, stops)), lambda s: s > F.col("pos"))
    return rows.select(F.explode(in_prefix).alias("stop"), "sym").groupBy("stop", "sym").agg(F.count("*").alias("n"))


def mapped_counts(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Counts with each named column of ranks cut at its own limit: ``least(rank, limit)``, then added up."""
    columns = [c for c in counts.columns if c != "n"]
    mapped: list[Column] = [F.least(F.col(c), F.lit(limits[c])).alias(c) if c in limits else F.col(c) for c in columns]
    return counts.select(*mapped, "n").groupBy(*columns).agg(F.sum("n").alias("n"))
