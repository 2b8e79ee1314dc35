import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyflow.llm.pair_association import association, exceeds, information, pack, sorted_pair_counts, unpack


def test_codes_of_unlike_pairs_differ_whatever_their_sign(spark):
    ends = [0, 1, -1, 2**20, 2**23, 2**31 - 1, -(2**31)]
    df = spark.createDataFrame([(a, b) for a in ends for b in ends], "a int, b int").withColumn("p", pack(F.col("a"), F.col("b")))
    a, b = unpack(F.col("p"))
    rows = df.select("a", "b", "p", a.alias("x"), b.alias("y")).collect()
    assert len({r["p"] for r in rows}) == len(ends) ** 2
    assert all((r["a"], r["b"]) == (r["x"], r["y"]) for r in rows)


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_run_lengths_equal_brute_force_with_a_hot_code(spark, kind):
    rng = random.Random(1)
    # Symbols, runs and groups on both sides of 20, 23 and 32 bits.
    symbols = [0, 1, 7, 2**20, 2**20 + 1, 2**31 - 1] + ([2**40, 2**41 + 1, -(2**62)] if kind == "bigint" else [-5])
    runs = [1, 2_800_000, 2**45]
    rows = [(i, runs[i % 3], "ya", 7, 2**20) if i % 3 == 0 else (i, rng.choice(runs), rng.choice(["ya", "yb", "other"]), rng.choice(symbols), rng.choice(symbols)) for i in range(4000)]
    rows = [(*r, rng.randrange(1, 5)) for r in rows]
    copies = rows + rng.sample(rows, 400)
    df = spark.createDataFrame([(*r, "clash") for r in copies], f"record bigint, run bigint, pair string, s {kind}, t {kind}, n int, code string").repartition(6)
    want = Counter()
    for _, g, p, s, t, n in rows:
        want[g, p, s, t] += n
    got = {(r["run"], r["pair"], r["s"], r["t"]): r["n"] for r in sorted_pair_counts(df, ["run", "pair"], "s", "t", "record", "n").collect()}
    assert got == want


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1, 1, 1), (1, None, 1, 1), (2, 3, 1, None), (3, 4, 2, 2), (4, 1, None, 2)], "r bigint, a int, b int, n int")
    assert [(r["a"], r["b"], r["n"]) for r in sorted_pair_counts(df, [], "a", "b", "r", "n").collect()] == [(4, 2, 2)]
    assert sorted_pair_counts(df.filter("r = 99"), [], "a", "b", "r", "n").collect() == []


def test_association(spark):
    cells = [(1, 0, 1, 40), (1, 0, 2, 2), (1, 2, 3, 50), (1, 1, 3, 1), (2, 0, 1, 1)]
    df = spark.createDataFrame(cells, "g int, a int, b int, c bigint")
    got = {(r["g"], r["a"], r["b"]): r for r in association(df, ["g"]).collect()}
    r = got[1, 0, 1]
    assert (r["m_a"], r["m_b"], r["t"]) == (42, 41, 93)
    assert r["factor"] == pytest.approx(2 * 93 * 40 / (42 * 41))
    assert r["log_odds"] == pytest.approx(math.log(40.5 * (93 - 42 - 41 + 40 + 0.5) / (2.5 * 1.5)))
    assert len(got) == 5
    big = association(df, ["g"], 30).filter(exceeds(4)).collect()
    assert {(r["a"], r["b"]) for r in big} == {(0, 1)}
    assert association(df.filter("g = 9"), ["g"]).collect() == []


def test_information_of_each_step(spark):
    rng = random.Random(2)
    rows = [(1, s, rng.randrange(4), rng.randrange(4), rng.randrange(1, 9)) for s in (1, 2, 2, 3) for _ in range(30)]
    df = spark.createDataFrame(rows, "g int, step int, k1 int, k2 int, n bigint")
    for r in information(df, ["g"], [1, 2, 3]).collect():
        cell, a, b = Counter(), Counter(), Counter()
        for _, s, x, y, n in rows:
            if s <= r["step"]:
                cell[x, y] += n
                a[x] += n
                b[y] += n
        t = sum(cell.values())
        assert r["n"] == t
        assert r["mi"] == pytest.approx(sum(n / t * math.log2(n * t / (a[x] * b[y])) for (x, y), n in cell.items()))


def test_exceeds_is_exact_beyond_64_bits(spark):
    big = 10**12
    df = spark.createDataFrame([(big * 4, big, big, big), (big * 4 - 1, big, big, big)], "t bigint, c bigint, m_a bigint, m_b bigint")
    assert [r["x"] for r in df.select(exceeds(8).alias("x")).collect()] == [True, False]
