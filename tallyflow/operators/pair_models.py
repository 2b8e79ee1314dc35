"""Laws of three symbols from their pairs: one-lag score, star, support triangles and margin fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.special import log2
from tallyflow.sources.tables import cut

#: Weight of the outer-product background of a pair law.
BACKGROUND = 1.0


def margins(pairs: DataFrame, a: str) -> DataFrame:
    """``a, n``."""
    return pairs.groupBy(a).agg(F.sum("n").alias("n"))


def pair_scores(pairs: DataFrame, a: str = "x1") -> DataFrame:
    """``y, a, n, log2p``: log2 p(y | a) of each seen pair under (c + w q_y q_a N / N) / ..., w the background.

    p(y, a) = (c(y, a) + w q_y q_a) / (N + w) with q the shares of y and of a; p(a) = q_a, thus
    p(y | a) = (c + w q_y q_a) / ((N + w) q_a).
    """
    whole = pairs.agg(F.sum("n").alias("t"))
    y = margins(pairs, "y").withColumnRenamed("n", "n_y")
    x = margins(pairs, a).withColumnRenamed("n", "n_a")
    out = pairs.join(y, "y").join(x, a).withColumn("t", whole.scalar().cast("double"))
    qy, qa = F.col("n_y") / F.col("t"), F.col("n_a") / F.col("t")
    return out.select("y", a, "n", log2((F.col("n") + BACKGROUND * qy * qa) / ((F.col("t") + BACKGROUND) * qa)).alias("log2p"))


def star_scores(triples: DataFrame) -> DataFrame:
    """``y, x1, x2, n, log2p``: log2 of p(y, a) p(y, b) / p(y), normalised over all y, for each seen triple.

    With A = c(y, a) / (N + w), B alike and k = w / (N + w) the sum over all y is
    sum A B / q_y + k q_b A. + k q_a B. + k^2 q_a q_b: only symbols seen with both contexts are joined.
    """
    ya = triples.groupBy("y", "x1").agg(F.sum("n").alias("ca"))
    yb = triples.groupBy("y", "x2").agg(F.sum("n").alias("cb"))
    y = triples.groupBy("y").agg(F.sum("n").alias("n_y"))
    a = triples.groupBy("x1").agg(F.sum("n").alias("n_a"))
    b = triples.groupBy("x2").agg(F.sum("n").alias("n_b"))
    whole = triples.agg(F.sum("n").alias("t"))
    t = whole.scalar().cast("double")
    ab = triples.select("x1", "x2").distinct()
    common = ab.join(ya, "x1").join(yb, ["x2", "y"]).join(y, "y").withColumn("t", t)
    overlap = common.groupBy("x1", "x2").agg(F.sum(F.col("ca") * F.col("cb") / (F.col("n_y") / F.col("t"))).alias("ab"))
    rows = triples.join(ya, ["y", "x1"]).join(yb, ["y", "x2"]).join(y, "y").join(a, "x1").join(b, "x2").join(overlap, ["x1", "x2"]).withColumn("t", t)
    w = BACKGROUND
    m = F.col("t") + w
    qy, qa, qb = F.col("n_y") / F.col("t"), F.col("n_a") / F.col("t"), F.col("n_b") / F.col("t")
    top = (F.col("ca") + w * qy * qa) / m * (F.col("cb") + w * qy * qb) / m / qy
    z = F.col("ab") / (m * m) + (w / m) * qb * F.col("n_a") / m + (w / m) * qa * F.col("n_b") / m + (w / m) * (w / m) * qa * qb
    return rows.select("y", "x1", "x2", "n", log2(top / z).alias("log2p"))


def triangles(ya: DataFrame, yb: DataFrame, ab: DataFrame) -> DataFrame:
    """``y, a, b, birth``: support triangles of three edge tables with columns (y, a), (y, b), (a, b) and ``birth``.

    A triangle is born with its last edge. Two equi-joins; the second is on both ends, so it emits no
    more rows than there are triangles.
    """
    first = ab.withColumnRenamed("birth", "b1").join(ya.withColumnRenamed("birth", "b2"), "a")
    both = first.join(yb.withColumnRenamed("birth", "b3"), ["y", "b"])
    return both.select("y", "a", "b", F.greatest("b1", "b2", "b3").alias("birth"))


def new_triangles(ya: DataFrame, yb: DataFrame, ab: DataFrame, at: int) -> DataFrame:
    """``y, a, b``: triangles born at ``at``, by three delta joins that own each triangle once.

    An edge table split into new (birth = at) and old: new AB with all, old AB with new YA and all YB,
    old AB with old YA and new YB.
    """
    upto = lambda e: e.filter(F.col("birth") <= at)
    new = lambda e: e.filter(F.col("birth") == at)
    old = lambda e: e.filter(F.col("birth") < at)
    parts = [triangles(upto(ya), upto(yb), new(ab)), triangles(new(ya), upto(yb), old(ab)), triangles(old(ya), new(yb), old(ab))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("y", "a", "b")


def edge_births(deltas: DataFrame, a: str, b: str) -> DataFrame:
    """``a, b, birth``: the first checkpoint at which each pair occurs."""
    return deltas.groupBy(a, b).agg(F.min("checkpoint").alias("birth"))


def proportional_fit(cells: DataFrame, targets: list[tuple[list[str], DataFrame]], rounds: int) -> DataFrame:
    """Iterative proportional fitting of ``keys.., q`` to margins [(columns, DataFrame columns.., p)].

    Each step rescales the cells of a margin's value by target over sum; cells outside a target's support get
    nothing. Rows stay one per cell. A step reads the cells twice (sums and cells), so a plan of several
    steps would double with each: every round is written as a table, which also cuts the lineage.
    """
    out = cells
    for _ in range(rounds):
        for columns, target in targets:
            sums = out.groupBy(*columns).agg(F.sum("q").alias("_s"))
            factor = sums.join(target, columns).select(*columns, (F.col("p") / F.col("_s")).alias("_f"))
            out = out.join(factor, columns, "left").withColumn("q", F.col("q") * F.coalesce("_f", F.lit(0.0))).drop("_f")
        out = cut(out, "fit")
    return out


def fit_error(cells: DataFrame, targets: list[tuple[list[str], DataFrame]]) -> DataFrame:
    """``margin, error``: the largest absolute difference between fitted and wanted margins."""
    parts = None
    for columns, target in targets:
        sums = cells.groupBy(*columns).agg(F.sum("q").alias("_s"))
        gap = target.join(sums, columns, "left").agg(F.max(F.abs(F.col("p") - F.coalesce("_s", F.lit(0.0)))).alias("error"))
        part = gap.select(F.lit(",".join(columns)).alias("margin"), "error")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def gated_scores(star: DataFrame, fitted: DataFrame) -> DataFrame:
    """``y, x1, x2, n, log2p``: the fitted law where the pair of contexts was fitted, the star elsewhere.

    ``fitted``: ``y, x1, x2, q`` (joint); q is normalised within (x1, x2).
    """
    rows = fitted.groupBy("x1", "x2").agg(F.sum("q").alias("_t"))
    law = fitted.join(rows, ["x1", "x2"]).select("y", "x1", "x2", log2(F.col("q") / F.col("_t")).alias("_l"))
    return star.join(law, ["y", "x1", "x2"], "left").select("y", "x1", "x2", "n", F.coalesce("_l", "log2p").alias("log2p"))


def triple_margins(triples: DataFrame) -> tuple[list[tuple[list[str], DataFrame]], DataFrame]:
    """Margins ``p`` of (y, x2), (x1, x2) and (y, x1) of a triple table, and the cells that all three support.

    The last margin is (y, x1), so a fit that ends a round with it has it exactly.
    """
    t = triples.agg(F.sum("n").alias("t"))
    p = triples.withColumn("p", F.col("n") / t.scalar())
    targets = [(list(c), cut(p.groupBy(*c).agg(F.sum("p").alias("p")), "margin")) for c in (("y", "x2"), ("x1", "x2"), ("y", "x1"))]
    yb, ab, ya = (x.drop("p") for _, x in targets)
    return targets, ab.join(ya, "x1").join(yb, ["y", "x2"])


def anchored_fit(triples: DataFrame, rounds: int, start: DataFrame | None = None) -> DataFrame:
    """``y, x1, x2, q``: joint law p(y, x1) r(x2 | x1) e^{u(y, x2) + v(x1, x2)} / Z(y, x1) fitted to all three pair margins.

    The factors u and v are updated by iterative scaling; the normaliser Z makes the (y, x1) margin exact at the end of
    every round (the anchor). Without rounds q is p(y, x1) r(x2 | x1) on the shared support: first order but for
    the cells outside it.
    ``start``: an earlier fit, whose values warm-start the cells that both have; new cells start from the base law.
    """
    targets, cells = triple_margins(triples)
    ab, ya = targets[1][1], targets[2][1]
    rows = ab.groupBy("x1").agg(F.sum("p").alias("_t"))
    base = cells.join(ab.join(rows, "x1").select("x1", "x2", (F.col("p") / F.col("_t")).alias("_r")), ["x1", "x2"]).join(ya, ["y", "x1"]).select("y", "x1", "x2", (F.col("p") * F.col("_r")).alias("q"))
    if start is not None:
        earlier = start.select("y", "x1", "x2", F.col("q").alias("_q"))
        base = base.join(earlier, ["y", "x1", "x2"], "left").select("y", "x1", "x2", F.coalesce("_q", "q").alias("q"))
    anchored = proportional_fit(cut(base, "anchored"), [targets[2]], 1)
    return proportional_fit(anchored, targets, rounds) if rounds else anchored


def anchored_scores(triples: DataFrame, fitted: DataFrame) -> DataFrame:
    """``n, bits, first_order_bits``: bits per symbol of p(y | x1, x2) of a fit, and of p(y | x1) on the same cells.

    Every observed triple lies in the fit's support if both come from the same triples; others aren't scored.
    """
    rows = fitted.groupBy("x1", "x2").agg(F.sum("q").alias("_t"))
    law = fitted.join(rows, ["x1", "x2"]).select("y", "x1", "x2", log2(F.col("q") / F.col("_t")).alias("_l"))
    whole = fitted.groupBy("x1").agg(F.sum("q").alias("_a"))
    first = fitted.groupBy("y", "x1").agg(F.sum("q").alias("_y")).join(whole, "x1").select("y", "x1", log2(F.col("_y") / F.col("_a")).alias("_m"))
    scored = triples.join(law, ["y", "x1", "x2"]).join(first, ["y", "x1"])
    n = F.sum("n")
    return scored.agg(n.alias("n"), (-F.sum(F.col("n") * F.col("_l")) / n).alias("bits"), (-F.sum(F.col("n") * F.col("_m")) / n).alias("first_order_bits"))


def fit_chain(blocks: DataFrame, checkpoints: list[int], rounds: int) -> list[tuple[int, DataFrame]]:
    """A fit after each checkpoint of ``checkpoint, y, x1, x2, n``, each warm-started from the one before."""
    out: list[tuple[int, DataFrame]] = []
    last = None
    for k in checkpoints:
        upto = cut(blocks.filter(F.col("checkpoint") <= k).groupBy("y", "x1", "x2").agg(F.sum("n").alias("n")), "upto")
        last = anchored_fit(upto, rounds, last)
        out.append((k, last))
    return out
