"""Which items stand together, and by how much more than chance.

Method: external sort of packed 64-bit pair codes. Both symbols of an occurrence are packed into one BIGINT;
Spark's range exchange and its sorter, which spills sorted runs and merges them, order the codes, and one
pass over each sorted partition counts run lengths. A redelivered record can only be told once its copies
meet, so occurrences are handed on one by one and combined after the sort. Association measures follow from
the run lengths: the factor over chance and the odds ratio with continuity correction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to each cell of the fourfold table before the odds ratio.
CONTINUITY = 0.5
#: Bits of a symbol in a packed code, and the types that fit into them.
SYMBOL_BITS = 32
_NARROW = ("tinyint", "smallint", "int")


def pack(a: Column, b: Column) -> Column:
    """``a << 32 | b`` of two symbols of at most 32 bits each, whatever their sign: unlike pairs have unlike codes."""
    low = F.lit((1 << SYMBOL_BITS) - 1)
    return F.shiftleft(a.cast("bigint"), SYMBOL_BITS).bitwiseOR(b.cast("bigint").bitwiseAND(low))


def unpack(code: Column) -> tuple[Column, Column]:
    """The two symbols of ``pack``, with their signs."""
    return F.shiftright(code, SYMBOL_BITS).cast("int"), F.shiftright(F.shiftleft(code, SYMBOL_BITS), SYMBOL_BITS).cast("int")


def _changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before it; the first one does."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return out


def _run_lengths(keys: int):
    """Counts of runs of equal keys (the first columns) in a partition sorted by (keys, record): a repeated record counts once.

    Only the run that a batch leaves open is carried into the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key: list | None = None
        last_record, total = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            fresh_key = np.logical_or.reduce([_changes(b.column(i)) for i in range(keys)])
            same_run = open_key is not None and all(b.column(i)[0].as_py() == v for i, v in enumerate(open_key))
            record, n = b.column(keys), b.column(keys + 1).to_numpy(zero_copy_only=False)
            fresh = fresh_key | _changes(record)
            fresh[0] = not (same_run and record[0].as_py() == last_record)
            starts = np.flatnonzero(fresh_key)
            sums = np.add.reduceat(np.where(fresh, n, 0), starts)
            if same_run:
                sums[0] += total
            elif open_key is not None:
                yield pa.RecordBatch.from_arrays([*[pa.array([v], b.column(i).type) for i, v in enumerate(open_key)], pa.array([total], pa.int64())], [*b.schema.names[:keys], "n"])
            done = pa.array(starts[:-1])
            if len(done):
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(done) for i in range(keys)], pa.array(sums[:-1], pa.int64())], [*b.schema.names[:keys], "n"])
            open_key = [b.column(i)[int(starts[-1])].as_py() for i in range(keys)]
            last_record, total = record[b.num_rows - 1].as_py(), int(sums[-1])
            kinds = [b.column(i).type for i in range(keys)]
            names = b.schema.names[:keys]
        if open_key is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([v], k) for v, k in zip(open_key, kinds)], pa.array([total], pa.int64())], [*names, "n"])

    return run


def sorted_pair_counts(pairs: DataFrame, group: list[str], a: str, b: str, record: str, n: str) -> DataFrame:
    """``group.., a, b, n``: the sum of n over the distinct records of each pair (a, b) of a group.

    Symbols of up to 32 bits share one packed code; wider ones stay two sort keys, which is exact for any
    BIGINT. Groups may be of any type. The range exchange splits by (group, code, record), so a pair with a
    third of all rows spreads over as many partitions as its rows need; each gives one partial run, and the
    partial runs of such pairs are added at the end by an ordinary aggregation (map-side first). Rows with
    a null in any of the columns are passed over; an empty table gives no rows.
    """
    kinds = dict(pairs.dtypes)
    packed = kinds[a] in _NARROW and kinds[b] in _NARROW
    codes = [pack(F.col(a), F.col(b)).alias("_code")] if packed else [F.col(a).cast("bigint").alias("_a"), F.col(b).cast("bigint").alias("_b")]
    flat = pairs.select(*group, *codes, F.col(record).alias("_record"), F.col(n).cast("bigint").alias("_n")).na.drop()
    order = [c for c in flat.columns if c != "_n"]
    keys = order[:-1]
    runs = flat.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
    kind = dict(flat.dtypes)
    counted = runs.mapInArrow(_run_lengths(len(keys)), ", ".join(f"{k} {kind[k]}" for k in keys) + ", n bigint").groupBy(*keys).agg(F.sum("n").alias("n"))
    ends = unpack(F.col("_code")) if packed else (F.col("_a"), F.col("_b"))
    return counted.select(*group, ends[0].alias(a), ends[1].alias(b), "n")


def association(cells: DataFrame, group: list[str], min_count: int = 1) -> DataFrame:
    """Association of each unordered pair from ``group.., a, b, c`` (one row per cell, a < b).

    m(x) is the sum of c over the pairs that contain x and t the sum over all pairs of the group, each
    counted before ``min_count`` is applied. Adds ``m_a, m_b, t``, ``factor`` = 2 t c / (m_a m_b), that
    is how often more than chance the two stand together, and ``log_odds`` = the natural log of the odds
    ratio of the table (c, m_a - c, m_b - c, t - m_a - m_b + c) with 1/2 added to each cell.

    Cells are already one row per pair, so a symbol joins at most as many rows as the group has symbols.
    """
    ends = cells.select(*group, F.explode(F.array("a", "b")).alias("x"), "c")
    m = ends.groupBy(*group, "x").agg(F.sum("c").alias("m"))
    t = m.groupBy(*group).agg(F.expr("sum(m) div 2").alias("t"))
    known = m.join(t, group)
    big = cells.filter(F.col("c") >= min_count)
    left = known.select(*group, F.col("x").alias("a"), F.col("m").alias("m_a"), "t")
    right = known.select(*group, F.col("x").alias("b"), F.col("m").alias("m_b"))
    out = big.join(left, [*group, "a"]).join(right, [*group, "b"])
    k = F.lit(CONTINUITY)
    c, ma, mb, t_ = (F.col(x).cast("double") for x in ("c", "m_a", "m_b", "t"))
    odds = F.log(c + k) + F.log(t_ - ma - mb + c + k) - F.log(ma - c + k) - F.log(mb - c + k)
    return out.select(*group, "a", "b", "c", "m_a", "m_b", "t", (2.0 * t_ * c / (ma * mb)).alias("factor"), odds.alias("log_odds"))


def exceeds(times: int) -> Column:
    """2 t c >= times m_a m_b in exact integers (products of BIGINT need more than 64 bits)."""
    wide = lambda x: F.col(x).cast("decimal(18,0)")
    return F.lit(2).cast("decimal(1,0)") * (wide("t") * wide("c")) >= F.lit(times).cast("decimal(2,0)") * (wide("m_a") * wide("m_b"))


def _xlogx(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x.cast("double"))).otherwise(0.0)


def information(counts: DataFrame, group: list[str], steps: list[int]) -> DataFrame:
    """Mutual information in bits between k1 and k2 of each group, after each step.

    counts: ``group.., step, k1, k2, n`` (increases, distinct records). The count of a cell at step s is
    the sum of its increases up to s. From I = log2 N + (sum f(n) - sum f(row) - sum f(col)) / N with
    f(x) = x log2 x the three sums are independent aggregations; no cell is joined to its margins.
    Result: ``group.., step, n, mi``; steps at which a group has no counts give no row.
    """
    upto = [F.sum(F.when(F.col("step") <= s, F.col("n")).otherwise(0)).alias(f"n{s}") for s in steps]
    again = [F.sum(f"n{s}").alias(f"n{s}") for s in steps]
    cell = counts.groupBy(*group, "k1", "k2").agg(*upto)
    parts = []
    for keys, sign in ((["k1", "k2"], 1), (["k1"], -1), (["k2"], -1)):
        level = cell if len(keys) == 2 else cell.groupBy(*group, *keys).agg(*again)
        parts.append(level.groupBy(*group).agg(*[(sign * F.sum(_xlogx(F.col(f"n{s}")))).alias(f"f{s}") for s in steps], *[(F.sum(f"n{s}") if len(keys) == 2 else F.lit(0).cast("bigint")).alias(f"n{s}") for s in steps]))
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*group).agg(*[F.sum(f"f{s}").alias(f"f{s}") for s in steps], *[F.sum(f"n{s}").alias(f"n{s}") for s in steps])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"n{s}").alias("n"), F.col(f"f{s}").alias("f")) for s in steps])).alias("e")
    flat = both.select(*group, each).select(*group, "e.step", "e.n", "e.f").filter("n > 0")
    return flat.select(*group, "step", "n", F.greatest(F.lit(0.0), F.log2(F.col("n").cast("double")) + F.col("f") / F.col("n")).alias("mi"))
