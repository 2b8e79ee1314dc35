import datetime as dt
import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyflow.operators import checkpoints, pair_models, pooled, vocabulary
from tallyflow.sources import streams
from tallyflow.streaming import counts


def triples(spark, n=300, v=4, seed=3):
    rng = random.Random(seed)
    c = Counter()
    a = b = 0
    for _ in range(n):
        y = (a + rng.choice([0, 1])) % v if b % 2 else rng.randrange(v)
        c[y, a, b] += 1
        a, b = y, a
    return c, spark.createDataFrame([(*k, n) for k, n in c.items()], "y int, x1 int, x2 int, n bigint")


def test_star_is_normalised_and_equals_the_dense_law(spark):
    c, df = triples(spark)
    t = sum(c.values())
    ca, cb, cy, na, nb = Counter(), Counter(), Counter(), Counter(), Counter()
    for (y, a, b), n in c.items():
        ca[y, a] += n
        cb[y, b] += n
        cy[y] += n
        na[a] += n
        nb[b] += n

    def weight(y, a, b):
        pa = (ca[y, a] + cy[y] / t * na[a] / t) / (t + 1)
        pb = (cb[y, b] + cy[y] / t * nb[b] / t) / (t + 1)
        return pa * pb / (cy[y] / t)

    got = pair_models.star_scores(df).collect()
    assert len(got) == len(c)
    for r in got:
        z = sum(weight(y, r["x1"], r["x2"]) for y in cy)
        assert r["log2p"] == pytest.approx(math.log2(weight(r["y"], r["x1"], r["x2"]) / z))


def test_pair_scores_are_laws(spark):
    _, df = triples(spark)
    pairs = df.groupBy("y", "x1").agg(F.sum("n").alias("n"))
    sums = pair_models.pair_scores(pairs).groupBy("x1").agg(F.sum(F.pow(F.lit(2.0), "log2p")).alias("s"), F.count("*").alias("k")).collect()
    assert all(r["s"] <= 1 + 1e-9 for r in sums) and any(r["s"] == pytest.approx(1) for r in sums if r["k"] == 4)


def test_triangles_and_ownership(spark):
    rng = random.Random(4)
    edges = [{(i, j): rng.randrange(1, 4) for i in range(5) for j in range(5) if rng.random() < 0.6} for _ in range(3)]
    ya, yb, ab = (spark.createDataFrame([(*k, b) for k, b in e.items()], f"{x} int, {y} int, birth int") for e, (x, y) in zip(edges, (("y", "a"), ("y", "b"), ("a", "b"))))
    want = {(y, a, b): max(edges[0][y, a], edges[1][y, b], edges[2][a, b]) for y, a, b in itertools.product(range(5), repeat=3) if (y, a) in edges[0] and (y, b) in edges[1] and (a, b) in edges[2]}
    got = pair_models.triangles(ya, yb, ab).collect()
    assert {(r["y"], r["a"], r["b"]): r["birth"] for r in got} == want and len(got) == len(want)
    for k in (1, 2, 3):
        new = [(r["y"], r["a"], r["b"]) for r in pair_models.new_triangles(ya, yb, ab, k).collect()]
        assert sorted(new) == sorted(t for t, b in want.items() if b == k)


def test_fit_and_anchor(spark):
    c, df = triples(spark)
    targets, support = pair_models.triple_margins(df)
    fitted = pair_models.proportional_fit(support.withColumn("q", F.lit(1.0)), targets, 12)
    assert all(r["error"] < 2e-3 for r in pair_models.fit_error(fitted, targets).collect())
    base = pair_models.anchored_scores(df, pair_models.anchored_fit(df, 0)).first()
    assert base["n"] == sum(c.values())
    law = pair_models.anchored_fit(df, 6)
    gap = {r["margin"]: r["error"] for r in pair_models.fit_error(law, targets).collect()}
    assert gap["y,x1"] < 1e-12 and gap["y,x2"] < 1e-2
    better = pair_models.anchored_scores(df, law).first()
    assert better["first_order_bits"] == pytest.approx(base["first_order_bits"])
    assert better["bits"] < base["bits"]
    again = pair_models.anchored_fit(df, 2, start=law)
    assert max(r["error"] for r in pair_models.fit_error(again, targets).collect()) <= max(gap.values()) + 1e-9
    star = pair_models.star_scores(df)
    gated = pair_models.gated_scores(star, law.filter("x1 = 0"))
    assert gated.count() == star.count()


def test_checkpoint_reports(spark):
    rng = random.Random(5)
    s = spark.createDataFrame([(i, [rng.choice("abc") for _ in range(50)]) for i in range(4)], "doc_id bigint, syms array<string>")
    v = vocabulary.top_symbols(s, 3, "doc_id")
    blocks = pooled.block_cells(s, v, 3, [1], [1, 5, 20, 50])
    costs = checkpoints.frozen_costs(blocks, 3, 4)
    assert sum(r["scored"] for r in checkpoints.interval_scores(costs).collect()) == 4 * 49
    rows = checkpoints.regret(blocks, 3, 4).collect()
    exact = {r["checkpoint"]: r["bits"] for r in checkpoints.prefix_bits(blocks, 3, 4).collect()}
    assert sum(r["exact_bits"] for r in rows) == pytest.approx(exact[3])
    assert max(r["upto"] for r in checkpoints.new_edges(blocks, "y", "x1").collect()) <= 9
    one, two = blocks.filter("checkpoint = 1"), blocks
    assert checkpoints.missing_keys(one, two, ["y", "x1"]).count() == 0
    ring = checkpoints.window_rings(checkpoints.anchored_costs(blocks, 4), [15, 45]).orderBy("stop").collect()
    assert ring[-1]["tokens"] == sum(r["ring_tokens"] for r in ring)


def test_streams_of_texts(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab 12\n é"), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["syms"] for r in streams.segments(df).collect()}
    assert got == {1: ["ab", " ", "12", "\n", " ", "é"], 3: []}
    assert {r["doc_id"]: r["syms"] for r in streams.words(df).collect()} == {1: ["ab", "12", "é"], 3: []}
    assert {r["doc_id"]: r["syms"] for r in streams.characters(df).collect()}[1] == list("ab 12\n é")
    assert {r["byte"]: r["n"] for r in streams.byte_histogram(df).collect()} == Counter("ab 12\n é".encode())
    m = streams.manifest(streams.segments(df), "segments").first()
    assert (m["n_symbols"], m["alphabet"]) == (6, 5)
    streams.save_stream(streams.segments(df), str(tmp_path / "s"))
    assert streams.load_stream(spark, str(tmp_path / "s")).count() == 2


def test_published_tokenizer(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    assert tiktoken
    df = spark.createDataFrame([("Hello world Hello",), (None,), ("",)], "text string")
    got = streams.tokenizer_counts(df, public.path("byte_bpe_50k.tiktoken"))
    assert got.agg(F.sum("n")).first()[0] == 3


def test_file_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(hours=5 * i), "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "ts timestamp, kind string").repartition(3)
    path = str(tmp_path / "e.parquet")
    df.write.parquet(path)
    assert {r["kind"]: r["n"] for r in counts.incremental_counts(spark, path, ["kind"]).collect()} == Counter(k for _, k in rows)
    got = {(r["start"], r["kind"]): r["n"] for r in counts.windowed_counts(spark, path, "ts", "kind").collect()}
    assert got == Counter((t.replace(hour=0), k) for t, k in rows)
    scores = counts.causal_scores(spark, path, "kind").collect()
    assert sum(r["records"] for r in scores) == 60 and len(scores) == 3
    assert min(r["bits"] for r in scores) == 0.0 and max(r["bits"] for r in scores) > 10


def test_cut_tables_are_dropped(spark):
    import os

    from tallyflow.sources.tables import cut, drop_cut_tables, work_dir

    df = cut(spark.range(5), "t")
    assert df.count() == 5
    where = work_dir(spark).removeprefix("file://").removeprefix("file:")
    assert os.listdir(where)
    drop_cut_tables(spark)
    assert not os.path.exists(where)


def test_windows_count_records_however_late(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    for k, rows in enumerate(([(day(0), "a"), (day(200), "a")], [(day(0), "a"), (day(199), "b")], [(day(0), "a")])):
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
    got = {(r["start"], r["kind"]): r["n"] for r in counts.windowed_counts(spark, f"{tmp_path}/t", "ts", "kind").collect()}
    assert got == {(day(0), "a"): 3, (day(200), "a"): 1, (day(199), "b"): 1}
