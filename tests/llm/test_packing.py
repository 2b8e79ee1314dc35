import random

import pandas as pd
import pytest

from tallyflow.llm.bin_packing import BUNDLES, _packer, best_fit, container_loads, least_containers, pack, pack_block

SCHEMA = "kind string, item_id bigint, pool string, size double, second double, capacity double, second_capacity double, block string"


def test_blocks_are_valid_and_no_worse_than_best_fit():
    rng = random.Random(4)
    for n in (0, 1, 5, 40, 120):
        items = [(rng.choice([0, rng.random() ** 2]), rng.choice([0, rng.random() / 4])) for _ in range(n)]
        bins = pack_block(items)
        assert sorted(k for b in bins for k in b) == list(range(n))
        for b in bins:
            assert sum(items[k][0] for k in b) <= 1 + 1e-9 and sum(items[k][1] for k in b) <= 1 + 1e-9
        assert len(bins) <= len(best_fit(sorted(items, reverse=True))) + 1


def test_finds_a_packing_that_best_fit_misses():
    items = [(x / 60, 0.0) for x in (33, 33, 27, 27, 30, 30, 16, 15, 14, 15, 44, 16)]
    need = sum(i[0] for i in items)
    assert len(pack_block(items)) == -int(-(need - 1e-9) // 1)


def test_every_item_once_and_no_container_over_its_capacity(spark):
    rng = random.Random(6)
    rows = [("job", i, "hot" if i % 3 else "small", rng.expovariate(1) * 12, float(rng.randrange(0, 9)), 100.0, 40.0, "x") for i in range(1500)]
    rows += [("job", 2000, "hot", 101.0, 1.0, 100.0, 40.0, "x"), ("job", 2001, "hot", 100.0, 41.0, 100.0, 40.0, "x"), ("job", 2002, "hot", 100.0, 40.0, 100.0, 40.0, "x")]
    rows += [("job", 2003, "hot", None, None, 100.0, 40.0, "x"), ("job", 2004, None, 5.0, 1.0, None, None, "x"), ("task", 1, "hot", 5.0, None, 10.0, None, "x"), ("task", 2, "hot", -3.0, None, 10.0, None, "x")]
    out = pack(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows) == len({(r["kind"], r["item_id"]) for r in out})
    by = {}
    for r in out:
        if r["status"] == "packed":
            by.setdefault((r["kind"], r["pool"], r["container"]), []).append(r)
        else:
            assert r["container"] is None
    for items in by.values():
        assert sum(max(0, r["size"] or 0) for r in items) <= items[0]["capacity"] + 1e-6
        if items[0]["second_capacity"]:
            assert sum(max(0, r["second"] or 0) for r in items) <= items[0]["second_capacity"] + 1e-6
    status = {(r["kind"], r["item_id"]): r["status"] for r in out}
    assert [status["job", i] for i in (2000, 2001, 2002, 2003, 2004)] == ["oversize", "oversize", "packed", "packed", "no_pool"]
    loads = {(r["kind"], r["pool"]): r for r in container_loads(pack(spark.createDataFrame(rows, SCHEMA))).collect()}
    hot = loads["job", "hot"]
    assert hot["least"] <= hot["containers"] <= 1.06 * hot["least"] + 1


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("items", [[(1.0, 1.0)] * 3, [(0.5, 0.5)] * 4, [(0.0, 0.0)] * 10])
def test_ties(items):
    assert len(pack_block(items)) == {3: 3, 4: 2, 10: 1}[len(items)]


def test_tiny_items_are_handed_on_in_few_bundles(spark):
    rows = [("job", i, "p", 0.001 * (1 + i % 3), None, 1.0, None, "x") for i in range(6000)]
    out = pack(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r["item_id"] for r in out}) == len(out) == 6000
    fill = {}
    for r in out:
        fill[r["container"]] = fill.get(r["container"], 0) + r["size"]
    assert max(fill.values()) <= 1 + 1e-9 and len(fill) <= 16
    block = pd.DataFrame({"kind": "job", "pool": "p", "block": 0, "piece": range(256), "size": 0.001, "second": None, "capacity": 1.0, "second_capacity": None})
    handed = _packer(0, False)(block)
    assert handed["bundle"].sum() == BUNDLES and not len(handed[~handed["bundle"] & handed["into"].isna()])


def test_lower_bounds():
    assert least_containers([]) == 0
    assert least_containers([(0.6, 0.0)] * 5) == 5
    assert least_containers([(0.0, 0.7)] * 3 + [(0.0, 0.4)] * 4) == 5
    rng = random.Random(3)
    for _ in range(30):
        items = [(rng.random(), rng.random() / 2) for _ in range(12)]
        assert least_containers(items) <= len(pack_block(items))
