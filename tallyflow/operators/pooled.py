"""Pooling experts of several lags, each frozen at the start of the block it codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.special import log2
from tallyflow.operators import counting, vocabulary

#: Pseudo-count by which a lag's row leans on the memoryless law.
ALPHA = 1.0


def geometric_edges(first: int, last: int, blocks: int) -> list[int]:
    """``blocks`` + 1 growing edges from ``first`` to ``last`` by a constant ratio, strictly rising."""
    ratio = (last / first) ** (1 / blocks)
    edges = [first]
    for k in range(1, blocks):
        edges.append(max(edges[-1] + 1, round(first * ratio**k)))
    return [*edges, max(last, edges[-1] + 1)]


def equal_edges(start: int, stop: int, blocks: int) -> list[int]:
    """``blocks`` + 1 edges at equal distances, cut to whole numbers."""
    return [start + int((stop - start) * k / blocks) for k in range(blocks + 1)]


def prefix_tables(stream: DataFrame, vocab: DataFrame, k: int, lags: list[int], edges: list[int | None]) -> DataFrame:
    """``checkpoint, lag, x, y, n``: capped counts of the positions before each block; lag 0 has x = -1.

    Block c is [edges[c-1], edges[c]), the last one up to the end if its edge is None; position is the index in a sequence, counts are over all sequences.
    """
    block = F.lit(0)
    for c, e in enumerate(edges[:-1], 1):
        block = F.when(F.col("pos") >= e, c).otherwise(block)
    parts = []
    for d in [0, *lags]:
        rows = counting.shifted(stream, [d] if d else [], d).filter(F.col("pos") < edges[-2])
        x = F.col("x1") if d else F.lit(None).cast("string")
        parts.append(rows.select(block.alias("block"), F.lit(d).alias("lag"), x.alias("x"), "y"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    raw = rows.groupBy("block", "lag", "x", "y").agg(F.count("*").alias("n"))
    cells = vocabulary.capped(raw, vocab, ["x", "y"], k)
    cells = cells.withColumn("x", F.when(F.col("lag") == 0, -1).otherwise(F.col("x")))
    later = F.filter(F.array(*[F.lit(c) for c in range(1, len(edges))]), lambda c: c > F.col("block"))
    return cells.select(F.explode(later).alias("checkpoint"), "lag", "x", "y", "n").groupBy("checkpoint", "lag", "x", "y").agg(F.sum("n").alias("n"))


def expert_laws(tables: DataFrame, lags: list[int], v: int) -> tuple[DataFrame, DataFrame]:
    """(memoryless law, lag laws) of each checkpoint over an alphabet of ``v``.

    ``checkpoint, y, q0`` for every symbol, seen or not; ``checkpoint, lag, x, y, ratio, row`` for seen cells, where
    ratio = p(y | x) / q0(y) and row = that ratio for unseen symbols, ALPHA / (n_x + ALPHA).
    """
    uni = tables.filter("lag = 0")
    total = uni.groupBy("checkpoint").agg(F.sum("n").alias("upto"))
    each = total.select("checkpoint", "upto", F.explode(F.sequence(F.lit(0), F.lit(v - 1))).alias("y"))
    q0 = each.join(uni.select("checkpoint", "y", "n"), ["checkpoint", "y"], "left").select("checkpoint", "y", ((F.coalesce("n", F.lit(0)) + 0.5) / (F.col("upto") + v / 2.0)).alias("q0"))
    cells = tables.filter("lag > 0")
    rows = cells.groupBy("checkpoint", "lag", "x").agg((ALPHA / (F.sum("n") + ALPHA)).alias("row"))
    laws = cells.join(rows, ["checkpoint", "lag", "x"]).join(q0, ["checkpoint", "y"])
    return q0, laws.select("checkpoint", "lag", "x", "y", (F.col("row") * (1 + F.col("n") / (ALPHA * F.col("q0")))).alias("ratio"), "row")


def block_cells(stream: DataFrame, vocab: DataFrame, k: int, lags: list[int], edges: list[int | None]) -> DataFrame:
    """``checkpoint, y, x1.., n``: what each block has to code, capped."""
    return vocabulary.capped(counting.interval_counts(stream, lags, edges), vocab, ["y", *[f"x{i}" for i in range(1, len(lags) + 1)]], k)


def expert_columns(cells: DataFrame, q0: DataFrame, laws: DataFrame, lags: list[int]) -> DataFrame:
    """The cells with ``q0`` and, per lag i, ``r<i>`` = p_i / q0 of the coded symbol and ``u<i>`` of unseen ones."""
    out = cells.join(q0, ["checkpoint", "y"])
    for i, d in enumerate(lags, 1):
        own = laws.filter(F.col("lag") == d)
        seen = own.select("checkpoint", F.col("x").alias(f"x{i}"), "y", F.col("ratio").alias(f"r{i}"))
        rows = own.select("checkpoint", F.col("x").alias(f"x{i}"), F.col("row").alias(f"u{i}")).distinct()
        out = out.join(rows, ["checkpoint", f"x{i}"], "left").join(seen, ["checkpoint", f"x{i}", "y"], "left")
        # A row without any count is the memoryless law itself.
        out = out.withColumn(f"u{i}", F.coalesce(f"u{i}", F.lit(1.0))).withColumn(f"r{i}", F.coalesce(f"r{i}", f"u{i}"))
    return out


def mixture_members(experts: DataFrame, weights: list[list[float]]) -> DataFrame:
    """``member, n_coded, bits``: sum over cells of -n log2(q0 (w0 + sum w_i r_i)) for each weight vector."""
    lags = len(weights[0]) - 1
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("member"), *[F.lit(float(w)).alias(f"w{j}") for j, w in enumerate(row)]) for i, row in enumerate(weights)])).alias("g")
    p = F.col("g.w0")
    for i in range(1, lags + 1):
        p = p + F.col(f"g.w{i}") * F.col(f"r{i}")
    rows = experts.select("n", "q0", *[f"r{i}" for i in range(1, lags + 1)], grid)
    return rows.groupBy("g.member").agg(F.sum("n").alias("n_coded"), F.sum(-F.col("n") * log2(F.col("q0") * p)).alias("bits"))


def product_members(experts: DataFrame, q0: DataFrame, laws: DataFrame, lags: list[int], powers: list[list[float]]) -> DataFrame:
    """``member, n_coded, bits`` of the tempered products q0 prod (p_i / q0)^b_i, normalised exactly.

    The normaliser over all symbols is a product over the unseen ratios times
    1 + sum over seen y of q0(y) (2^D(y) - 1), D(y) = sum b_i log2(ratio_i(y) / unseen_i): only seen cells of
    a context's rows are read. For weights on more than two rows the same sums hold.
    """
    k = len(lags)
    xs = [f"x{i}" for i in range(1, k + 1)]
    us = [f"u{i}" for i in range(1, k + 1)]
    contexts = experts.groupBy("checkpoint", *xs, *us).agg(F.sum("n").alias("m"))
    seen = None
    for i in range(1, k + 1):
        own = laws.filter(F.col("lag") == lags[i - 1]).select("checkpoint", F.col("x").alias(f"x{i}"), "y", log2(F.col("ratio") / F.col("row")).alias("d"))
        part = contexts.join(own, ["checkpoint", f"x{i}"]).select("checkpoint", *xs, "y", *[(F.col("d") if j == i else F.lit(0.0)).alias(f"d{j}") for j in range(1, k + 1)])
        seen = part if seen is None else seen.unionByName(part)
    both = seen.groupBy("checkpoint", *xs, "y").agg(*[F.sum(f"d{j}").alias(f"d{j}") for j in range(1, k + 1)]).join(q0, ["checkpoint", "y"])
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("member"), *[F.lit(float(b)).alias(f"b{j}") for j, b in enumerate(row, 1)]) for i, row in enumerate(powers)])).alias("g")
    shift = sum((F.col(f"g.b{j}") * F.col(f"d{j}") for j in range(1, k + 1)), F.lit(0.0))
    z = both.select("*", grid).groupBy("checkpoint", *xs, F.col("g.member").alias("member")).agg((1.0 + F.sum(F.col("q0") * (F.pow(F.lit(2.0), shift) - 1.0))).alias("z"))
    coded = experts.select("*", grid).withColumn("member", F.col("g.member"))
    joined = coded.join(z, ["checkpoint", *xs, "member"], "left")
    gain = sum((F.col(f"g.b{j}") * (log2(F.col(f"r{j}")) - log2(F.col(f"u{j}"))) for j in range(1, k + 1)), F.lit(0.0))
    bits = -F.col("n") * (log2(F.col("q0")) + gain - log2(F.coalesce("z", F.lit(1.0))))
    return joined.groupBy("member").agg(F.sum("n").alias("n_coded"), F.sum(bits).alias("bits"))
