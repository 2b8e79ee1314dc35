"""Items of varying size in containers of fixed capacity, whole and with little space left over.

Method: bin completion by branch and bound. Within a block of items the largest unplaced item opens a
container; the undominated ways to fill it up are enumerated, those with the least waste first; a branch
is cut when its waste exceeds what a better packing could afford; best-fit decreasing gives the first
incumbent, and the search ends once it meets a lower bound. Blocks are random parts of a pool, so each has
the pool's mix of sizes. Afterwards the few containers of each block that are filled least are opened again
and packed together with those of other blocks, in rounds of bounded fan-in. What is handed on are bundles,
at most BUNDLES a container however many items it holds, so no task ever holds a pool.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.sources.tables import cut

#: Items of a block, blocks merged in a round, containers that a block hands on, the bundles in which the items of
#: such a container go on, and the fill from which a container is left closed.
BLOCK_ITEMS, FAN_IN, HANDED_ON, BUNDLES, WELL_FILLED = 256, 16, 6, 8, 0.97
#: Fillings enumerated per container, steps to enumerate them, and containers tried per block.
FILLINGS, STEPS, NODES = 8, 120, 600

Item = tuple[float, float]


def best_fit(items: list[Item]) -> list[list[int]]:
    """Best-fit decreasing: each item (largest first) goes where the least space is left."""
    bins: list[list] = []
    for k, (x, y) in enumerate(items):
        best = None
        for b in bins:
            if b[0] + x <= 1 and b[1] + y <= 1 and (best is None or b[0] + b[1] > best[0] + best[1]):
                best = b
        if best is None:
            bins.append([x, y, [k]])
        else:
            best[0] += x
            best[1] += y
            best[2].append(k)
    return [b[2] for b in bins]


def fillings(items: list[Item], free: list[int], sizes: list[float]) -> list[tuple[float, float, list[int]]]:
    """(space left, second space left, members) of undominated ways to fill the container of free[0].

    ``free`` are the unplaced items, largest first, ``sizes`` their negated larger shares. A filling is
    listed only if no unplaced item fits on top of it, or in place of a smaller member (it would be at
    least as good); of those the FILLINGS with the least space left.
    """
    out: list[tuple[float, float, list[int]]] = []
    first = free[0]
    steps = 0
    stack = [(1, 1 - items[first][0], 1 - items[first][1], [0])]
    while stack and steps < STEPS:
        at, x, y, members = stack.pop()
        steps += 1
        # The first unplaced item from ``at`` on that can fit: its larger share is within the larger space.
        k = max(at, bisect_left(sizes, -max(x, y) - 1e-12))
        while k < len(free) and not (items[free[k]][0] <= x + 1e-12 and items[free[k]][1] <= y + 1e-12):
            k += 1
        if k == len(free):
            out.append((x, y, members))
            if len(out) >= 4 * FILLINGS or min(x, y) < 1e-9:
                break
            continue
        px, py = items[free[k]]
        # Without it: the next one that differs.
        j = k + 1
        while j < len(free) and items[free[j]] == (px, py):
            j += 1
        if j < len(free):
            stack.append((j, x, y, members))
        stack.append((k + 1, x - px, y - py, [*members, k]))
    kept = []
    for x, y, members in sorted(out, key=lambda f: (min(f[0], f[1]), f[0] + f[1])):
        inside = set(members)
        dominated = False
        for m in members[1:]:
            px, py = items[free[m]]
            j = m - 1
            if j > 0 and j not in inside:
                qx, qy = items[free[j]]
                if qx >= px and qy >= py and (qx, qy) != (px, py) and qx - px <= x and qy - py <= y:
                    dominated = True
                    break
        if not dominated:
            kept.append((x, y, members))
            if len(kept) == FILLINGS:
                break
    return kept or out[:1]


def least_containers(items: list[Item]) -> int:
    """No packing needs fewer: of either resource alone, the sum, and for each limit the large items with what small ones don't fit beside them."""
    if not items:
        return 0
    best = 1
    for d in (0, 1):
        x = np.sort(np.array([i[d] for i in items]))
        best = max(best, int(np.ceil(x.sum() - 1e-9)))
        upto = np.r_[0.0, np.cumsum(x)]
        half = int(np.searchsorted(x, 0.5 + 1e-12))
        for limit in np.unique(x[:half]):
            small = int(np.searchsorted(x, limit - 1e-12))
            alone = int(np.searchsorted(x, 1 - limit + 1e-12))
            alone = max(alone, half)
            beside = (alone - half) - (upto[alone] - upto[half])
            best = max(best, len(x) - half + max(0, int(np.ceil(upto[half] - upto[small] - beside - 1e-9))))
        best = max(best, len(x) - half)
    return best


def pack_block(items: list[Item]) -> list[list[int]]:
    """Containers as lists of item numbers; items are shares (first, second resource) of a capacity, each at most 1.

    Exact if the search ends within NODES containers; else the best packing found so far, never worse than
    best-fit decreasing.
    """
    order = sorted(range(len(items)), key=lambda k: (-max(items[k]), -min(items[k]), k))
    ranked = [items[k] for k in order]
    best = best_fit(ranked)
    sums = [sum(i[d] for i in ranked) for d in (0, 1)]
    least = least_containers(ranked)
    nodes = 0
    stack = [(list(range(len(ranked))), [], 0.0, 0.0)]
    while stack and len(best) > least and nodes < NODES:
        free, done, wx, wy = stack.pop()
        if not free:
            if len(done) < len(best):
                best = done
            continue
        spare = len(best) - 1
        if len(done) + 1 > spare or wx > spare - sums[0] + 1e-9 or wy > spare - sums[1] + 1e-9:
            continue
        nodes += 1
        sizes = [-max(ranked[k]) for k in free]
        for x, y, members in reversed(fillings(ranked, free, sizes)):
            inside = set(members)
            rest = [f for k, f in enumerate(free) if k not in inside]
            stack.append((rest, [*done, [free[m] for m in members]], wx + x, wy + y))
    return [[order[k] for k in b] for b in best]


_PACKED = "bundle boolean, kind string, pool string, block bigint, piece bigint, size double, second double, capacity double, second_capacity double, status string, container bigint, into bigint"
_COLUMNS = [x.split()[0] for x in _PACKED.split(", ")]


def pack(items: DataFrame) -> DataFrame:
    """Containers for ``kind, item_id, pool, size, second, capacity, second_capacity``.

    Result: the same with ``status`` and ``container`` (numbers within kind and pool). Status: ``packed``;
    ``oversize`` for an item larger than its capacity in either resource, which has no container;
    ``no_pool`` if neither capacity is known. A null or negative size takes no room and exceeds nothing; a
    null capacity of one resource doesn't limit. Items must be distinct in (kind, item_id).

    A piece is an item in the first round and a bundle of pieces later. Each round is written; its rows say of
    each piece the container that holds it or the bundle ``into`` which it went. Containers of bundles are
    handed back to their items by a join a round, along the few pieces that were handed on.
    """
    spark = items.sparkSession
    counted = items.groupBy("kind", "pool").agg(F.ceil(F.count("*") / BLOCK_ITEMS).alias("_blocks"))
    spread = items.join(counted, (items["kind"] == counted["kind"]) & items["pool"].eqNullSafe(counted["pool"])).drop(counted["kind"]).drop(counted["pool"])
    spread = spread.withColumn("block", F.pmod(F.xxhash64("item_id"), F.col("_blocks")))
    blocks = counted.agg(F.max("_blocks")).first()[0] or 0
    state = spread.select("kind", "pool", "block", F.col("item_id").cast("bigint").alias("piece"), *[F.col(c).cast("double").alias(c) for c in ("size", "second", "capacity", "second_capacity")])
    # A given number of partitions isn't merged afterwards: packing is costly although its rows are few.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rounds: list[DataFrame] = []
    while True:
        final = blocks <= 1
        keyed = state.repartition(parts, "kind", "pool", "block").groupBy("kind", "pool", "block")
        rounds.append(cut(keyed.applyInPandas(_packer(len(rounds), final), _PACKED), f"pack{len(rounds)}"))
        if final:
            break
        blocks = -(-blocks // FAN_IN)
        state = rounds[-1].filter("bundle").withColumn("block", F.floor(F.col("block") / FAN_IN)).select("kind", "pool", "block", "piece", "size", "second", "capacity", "second_capacity")
    placed = None
    for table in reversed(rounds):
        pieces = table.filter("not bundle").drop("bundle", "block")
        stay = pieces.filter("into is null").drop("into")
        if placed is not None:
            above = placed.select("kind", "pool", F.col("piece").alias("into"), F.col("container").alias("_container"))
            moved = pieces.filter("into is not null").join(above, ["kind", "pool", "into"])
            stay = stay.unionByName(moved.withColumn("container", F.col("_container")).drop("into", "_container"))
        placed = stay
    return placed.withColumnRenamed("piece", "item_id").select("kind", "item_id", "pool", "size", "second", "capacity", "second_capacity", "status", "container")


def _bundles(members: list[int], shares: np.ndarray) -> list[list[int]]:
    """The members in at most BUNDLES groups: the largest by themselves, the rest together."""
    ranked = sorted(members, key=lambda k: (-shares[k], k))
    return [[k] for k in ranked] if len(ranked) <= BUNDLES else [*[[k] for k in ranked[: BUNDLES - 1]], ranked[BUNDLES - 1 :]]


def _packer(turn: int, final: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.sort_values("piece").reset_index(drop=True)
        size = out["size"].fillna(0).clip(lower=0)
        second = out["second"].fillna(0).clip(lower=0)
        # Bundles fitted a container once; that their sum is rounded doesn't make them oversize.
        slack = 1e-9 if turn else 0.0
        over = (size > out["capacity"] * (1 + slack)) | (second > out["second_capacity"] * (1 + slack))
        unknown = out["capacity"].isna() & out["second_capacity"].isna()
        out["status"] = "packed"
        out.loc[over, "status"] = "oversize"
        out.loc[unknown, "status"] = "no_pool"
        fits = out.index[~over & ~unknown].to_numpy()
        share = lambda v, c: np.minimum((v / c.where(c > 0)).fillna(0).to_numpy(), 1.0)
        a, b = share(size, out["capacity"]), share(second, out["second_capacity"])
        larger = np.maximum(a, b)
        containers = [fits[members] for members in pack_block(list(zip(a[fits].tolist(), b[fits].tolist())))]
        loads = [max(a[rows].sum(), b[rows].sum()) for rows in containers]
        by_load = [] if final else [n for n in sorted(range(len(loads)), key=lambda n: (loads[n], n))[:HANDED_ON] if loads[n] < WELL_FILLED]
        container, into = pd.array([None] * len(out), "Int64"), pd.array([None] * len(out), "Int64")
        first = (turn << 56) + (int(out["block"].iloc[0]) << 16)
        handed = []
        for n, rows in enumerate(containers):
            if n not in by_load:
                container[rows] = first + n
                continue
            for group in _bundles(rows.tolist(), larger):
                into[group] = first + len(handed)
                handed.append((float(size[group].sum()), float(second[group].sum())))
        out["container"], out["into"], out["bundle"] = container, into, False
        bundles = pd.DataFrame(handed, columns=["size", "second"]).assign(piece=[first + k for k in range(len(handed))], bundle=True, container=None, into=None, status=None)
        for c in ("kind", "pool", "block", "capacity", "second_capacity"):
            bundles[c] = out[c].iloc[0]
        return pd.concat([out[_COLUMNS], bundles[_COLUMNS].astype({"container": "Int64", "into": "Int64"})]) if handed else out[_COLUMNS]

    return run


def container_loads(packed: DataFrame) -> DataFrame:
    """Per kind and pool: items, containers, the fewest any packing needs, by how many it is more, the mean fill, and unplaced items."""
    each = packed.filter("status = 'packed'").groupBy("kind", "pool", "container").agg(F.count("*").alias("items"), F.sum("size").alias("size"), F.sum("second").alias("second"), F.max("capacity").alias("capacity"), F.max("second_capacity").alias("second_capacity"))
    whole = each.groupBy("kind", "pool").agg(
        F.sum("items").alias("items"), F.count("*").alias("containers"),
        F.ceil(F.greatest(F.sum("size") / F.max("capacity"), F.coalesce(F.sum("second") / F.max("second_capacity"), F.lit(0.0))) - 1e-9).alias("least"),
        F.round(F.avg(F.greatest(F.col("size") / F.col("capacity"), F.coalesce(F.col("second") / F.col("second_capacity"), F.lit(0.0)))), 4).alias("mean_fill"),
    )
    left = packed.groupBy("kind", "pool").agg(F.count_if(F.col("status") != "packed").alias("unplaced"))
    return left.join(whole, (left["kind"] == whole["kind"]) & left["pool"].eqNullSafe(whole["pool"]), "left").select(left["kind"], left["pool"], "items", "containers", "least", (F.col("containers") - F.col("least")).alias("gap"), "mean_fill", "unplaced")


def check_packing(packed: DataFrame) -> DataFrame:
    """Per kind and pool: ``items``, those ``placed`` and ``unplaced``, items placed ``twice`` and containers ``overfull`` (both should be 0)."""
    placed = packed.filter("status = 'packed'")
    copies = placed.groupBy("kind", "pool", "item_id").agg((F.count("*") - 1).alias("more")).groupBy("kind", "pool").agg(F.sum("more").alias("twice"))
    fill = placed.groupBy("kind", "pool", "container").agg(F.sum(F.greatest("size", F.lit(0.0))).alias("a"), F.sum(F.greatest("second", F.lit(0.0))).alias("b"), F.max("capacity").alias("ca"), F.max("second_capacity").alias("cb"))
    # Sums of doubles may pass a capacity by rounding alone.
    over = (F.col("a") > F.col("ca") * (1 + 1e-9)) | (F.col("b") > F.col("cb") * (1 + 1e-9))
    full = fill.groupBy("kind", "pool").agg(F.count_if(over | F.col("container").isNull()).alias("overfull"))
    whole = packed.groupBy("kind", "pool").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "packed").alias("placed"), F.count_if(F.col("status") != "packed").alias("unplaced"))
    for part in (copies, full):
        named = part.withColumnsRenamed({"kind": "_kind", "pool": "_pool"})
        whole = whole.join(named, (F.col("kind") == F.col("_kind")) & F.col("pool").eqNullSafe(F.col("_pool")), "left").drop("_kind", "_pool")
    return whole.select("kind", "pool", "items", "placed", "unplaced", F.coalesce("twice", F.lit(0)).alias("twice"), F.coalesce("overfull", F.lit(0)).alias("overfull"))
