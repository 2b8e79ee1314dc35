from collections import Counter

from pyspark.sql import functions as F

from tallyflow.operators.tree_aggregate import distinct_records, heavy_keys, tree_aggregate


def rows(spark, n=3000):
    # Key 0 holds a third of all rows; some keys are null; every tenth row comes twice.
    data = [(i, None if i % 50 == 0 else 0 if i % 3 == 0 else i % 97, i % 7, "x") for i in range(n)]
    data += data[::10]
    return spark.createDataFrame(data, "id bigint, k bigint, v int, _key string")


def test_counts_equal_brute_force_for_any_fan_in(spark):
    one = distinct_records(rows(spark), "id", {"k": F.col("k"), "v": F.col("v")})
    want = Counter()
    total = Counter()
    for i in range(3000):
        k = None if i % 50 == 0 else 0 if i % 3 == 0 else i % 97
        want[k] += 1
        total[k] += i % 7
    for fan_in, chunks in ((2, 64), (16, 4), (3, 200)):
        got = tree_aggregate(one, "k", {"c": ("count", "_id"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, fan_in, chunks).collect()
        assert {r["k"]: r["c"] for r in got} == want
        assert {r["k"]: r["s"] for r in got} == total
        assert all(0 <= r["lo"] <= r["hi"] <= 6 for r in got)


def test_heavy_keys_and_null_key(spark):
    one = distinct_records(rows(spark), "id", {"k": F.col("k")})
    per = tree_aggregate(one, "k", {"c": ("count", "_id")})
    heavy = heavy_keys(per, "k", "c", 2, include_null=True).collect()
    assert [r["k"] for r in heavy] == [0]
    assert heavy[0]["share"] > 0.3


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id bigint, k bigint, v int")
    per = tree_aggregate(distinct_records(empty, "id", {"k": F.col("k"), "v": F.col("v")}), "k", {"c": ("count", "_id"), "s": ("sum", "v")})
    assert per.collect() == []
    assert heavy_keys(per, "k", "c", 2).collect() == []


def test_rows_without_id_are_no_records_and_copies_count_once(spark):
    df = spark.createDataFrame([(None, 1, 5), (1, 1, 5), (1, 1, 5), (2, 1, None)], "id bigint, k bigint, v int")
    got = tree_aggregate(distinct_records(df, "id", {"k": F.col("k"), "v": F.col("v")}), "k", {"c": ("count", "_id"), "s": ("sum", "v")}).collect()
    assert [(r["k"], r["c"], r["s"]) for r in got] == [(1, 2, 5)]
