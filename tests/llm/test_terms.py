import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyflow.llm.term_frequency import DIGITS, END, LATER, LETTERS, SuffixArray, bands, one_per_record, run_frequencies

SCHEMA = "segment_id bigint, tokens array<int>, vocabulary array<string>, written_at timestamp, terms string"


def encode(words):
    voc, tokens = [], []
    for w in words:
        if w in voc:
            tokens.append(LATER + voc.index(w))
        else:
            tokens.append(DIGITS if w.isdigit() else LETTERS)
            voc.append(w)
        tokens.append(32)
    return [*tokens, END], voc


def brute(records, depth):
    occ, rec = Counter(), Counter()
    for words in records:
        seen = set()
        for n in range(1, depth + 1):
            for i in range(len(words) - n + 1):
                g = tuple(words[i : i + n])
                occ[g] += 1
                seen.add(g)
        rec.update(seen)
    return {g: (occ[g], rec[g]) for g in occ}


def test_intervals_equal_brute_force_up_to_the_longest_record():
    rng = random.Random(8)
    for turn in range(30):
        records = [[rng.randrange(1 + turn % 4) for _ in range(rng.randrange(0, 40))] for _ in range(12)]
        records += [records[0], records[1] * 2]
        code = np.array([w for r in records for w in r], np.int64)
        record = np.array([i for i, r in enumerate(records) for _ in r], np.int64)
        array = SuffixArray.of(code, record)
        longest = max(map(len, records))
        got = {}
        for n in range(1, longest + 1):
            for a, o, r in zip(*array.intervals(n)):
                got[tuple(code[a : a + n].tolist())] = (o, r)
        assert got == brute(records, longest)
        assert not len(array.intervals(longest + 1)[0])


def test_frequencies_of_a_table(spark):
    rng = random.Random(9)
    records = [[rng.choice(["the", "The", "a", "42", "x"]) for _ in range(rng.randrange(0, 40))] for _ in range(50)]
    rows = [(i, *encode(w), None, "clash") for i, w in enumerate(records)]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    one = one_per_record(df, "segment_id", ("tokens", "vocabulary"), "written_at")
    got = {tuple(r["terms"]): (r["occurrences"], r["records"]) for r in run_frequencies(one, 1, None).collect()}
    assert got == brute(records, 40)


def test_dirty_records(spark):
    rows = [
        (1, None, ["a"], None, ""), (2, [], ["a"], None, ""), (3, [LETTERS, 32], ["a", "b", "c"], None, ""), (4, [LETTERS, LETTERS, END], ["a"], None, ""),
        (5, [LETTERS, END, LATER, LETTERS], ["a", "z"], None, ""), (6, [LETTERS, LATER + 5, LATER], ["a"], None, ""), (7, [LETTERS, LETTERS, LATER], ["q", "q"], None, ""), (8, [LETTERS], None, None, ""),
        (None, [LETTERS], ["n"], None, ""), (9, [LETTERS, LETTERS], [None, "b"], None, ""),
    ]
    one = one_per_record(spark.createDataFrame(rows, SCHEMA), "segment_id", ("tokens", "vocabulary"), "written_at")
    got = {r["terms"][0]: (r["occurrences"], r["records"]) for r in run_frequencies(one).collect()}
    assert got == {"a": (5, 4), "q": (3, 1), "b": (1, 1)}


def test_bands_and_empty(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (5,)], "r bigint")
    assert [r["b"] for r in df.select(bands(F.col("r"), F.lit(10)).alias("b")).collect()] == [["rare"], ["rare"], [], ["common"]]
    assert run_frequencies(spark.createDataFrame([], SCHEMA)).collect() == []
