import random

import numpy as np
import pytest

from tallyflow.llm.leakage import LEAK, Buckets, _project, _unit, common_run, common_subsequence, known_share, label, leaks, words_of
from tallyflow.llm.leakage_queries import PARAPHRASED

WORDS = [f"w{i}" for i in range(60)]


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - LEAK + 1):
            grams.setdefault(tuple(w[k : k + LEAK]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words_of(t)] for k in range(len(w) - LEAK + 1) for i in grams.get(tuple(w[k : k + LEAK]), ())}


def test_words():
    assert words_of("Don’t Stop, 42x—ÉA") == ["don", "t", "stop", "42x", "a"]
    assert words_of(None) == words_of("") == []


def test_runs_and_subsequences():
    a, b = np.array([1, 2, 3, 4, 9]), np.array([7, 2, 3, 4, 8])
    assert common_run(a, 1, b, 1) == 3
    rng = random.Random(1)
    for _ in range(50):
        x, y = ([rng.randrange(4) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        d = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                d[i + 1][j + 1] = d[i][j] + 1 if p == q else max(d[i][j + 1], d[i + 1][j])
        assert common_subsequence(np.array(x, int), np.array(y, int)) == d[-1][-1]


def test_found_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(5, 60)))) for i in range(30)]
    items += [(30, items[0][1]), (31, None), (32, ""), (33, "short one"), (None, items[1][1])]
    docs = []
    for d in range(120):
        own = " ".join(rng.choices(WORDS + [f"x{k}" for k in range(60)], k=80))
        if d % 3 == 0:
            w = words_of(items[rng.randrange(30)][1])
            n = min(len(w), rng.choice([11, 12, 13, 30]))
            a = rng.randrange(0, len(w) - n + 1)
            own += " ‘" + ", ".join(x.upper() for x in w[a : a + n]) + "’ " + own
        docs.append((d, own))
    docs += [(900, None), (901, ""), (902, items[2][1]), (903, items[2][1])]
    dd = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id bigint, text string, start string")
    ii = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, doc int")
    want = brute(docs, [x for x in items if x[0] is not None])
    assert len(want) > 20
    got = {(r["doc_id"], r["item_id"]) for r in leaks(dd, ii, 0.99, False).collect() if r["run"] >= LEAK}
    assert got == want
    rated = {(r["doc_id"], r["item_id"]): r for r in leaks(dd, ii, 0.85, True).collect()}
    assert {k for k, r in rated.items() if r["run"] >= LEAK} == want
    assert all(r["lcs"] >= r["run"] and 0 <= r["share"] <= 1 and 0 <= r["answer"] <= 1 for r in rated.values())


def test_a_paraphrase_is_rated(spark):
    text = "the longer ranking absorbs every hidden ledger before one spare lattice reveals the final codebook twice"
    other = text.replace("every", "one").replace("final", "longer")
    dd = spark.createDataFrame([(1, "Note. " + other), (2, "nothing of the kind")], "doc_id bigint, text string")
    ii = spark.createDataFrame([(5, text)], "item_id bigint, text string")
    got = leaks(dd, ii, 0.7, True).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)]
    assert got[0]["share"] > 0.8 and got[0]["run"] < LEAK


def test_a_paraphrase_with_words_of_no_item_is_rated(spark):
    # No twelve known words in a row are left: every eighth word is one that no item has.
    w = words_of("the longer ranking absorbs every hidden ledger before one spare lattice reveals the final codebook twice and then a fifth sentence closes it")
    other = " ".join("xylophone" if k % 8 == 7 else x for k, x in enumerate(w))
    dd = spark.createDataFrame([(1, "Quite unrelated opening words stand here. " + other), (2, "nothing of the kind is said in this other text at all"), (3, "the longer ranking")], "doc_id bigint, text string")
    ii = spark.createDataFrame([(5, " ".join(w))], "item_id bigint, text string")
    got = leaks(dd, ii, 0.7, True).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)]
    assert got[0]["run"] < LEAK and got[0]["lcs"] == sum(x == y for x, y in zip(w, other.split())) and got[0]["share"] > 0.8


def test_known_share_is_the_share_of_the_length():
    idf = np.array([2.0, 3.0, 1.5])
    windows = np.array([[0, 0, 1, -1, -1, 1, 1, 0], [-1] * 8, [0, 1, 0, 1, 0, 1, 0, 1]])
    want = [np.sqrt((6**2 + 9**2) / (6**2 + 9**2 + 3**2)), 0, 1]
    assert known_share(windows, idf) == pytest.approx(want)


@pytest.mark.parametrize("docs,items", [([], [(1, "a b c d e f g h i j k l m")]), ([(1, "a b c")], []), ([(1, "a b c")], [(1, None)])])
def test_empty(spark, docs, items):
    dd, ii = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert leaks(dd, ii, 0.99, False).collect() == []


def test_buckets_find_most_pairs_of_the_cosine_asked_for():
    rng = np.random.default_rng(4)
    space = rng.standard_normal((500, 32)).astype(np.float32)
    passages = rng.integers(0, 500, (3000, 8)).astype(np.int32)
    probes = passages[rng.integers(0, 3000, 1500)].copy()
    for row in probes[100:]:
        at = rng.integers(0, 8, 2)
        row[at] = rng.integers(0, 500, 2)
    buckets, targets = Buckets(space, passages, 0.8), _unit(_project(passages, space))
    near = set(zip(*map(np.ndarray.tolist, np.nonzero(_unit(_project(probes, space)) @ targets.T >= 0.8))))
    got = {(r, c) for rows, cols in buckets.pairs(_project(probes, space)) for r, c in zip(rows.tolist(), cols.tolist())}
    assert len(near) > 300 and len(near & got) / len(near) >= 0.9
    assert len(got) < 0.5 * probes.shape[0] * len(passages)
    equal = {(r, c) for r in range(100) for c in np.flatnonzero((passages == probes[r]).all(1)).tolist()}
    assert equal <= got


def test_planted_paraphrases_are_found(spark):
    """Recall of paraphrases by swaps for words of no item and insertions: at least 0.9, labelled as such."""
    rng = random.Random(5)
    common, rare = [f"c{k}" for k in range(120)], [f"r{k}" for k in range(3000)]
    sentence = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i, sentence(rng.randrange(30, 80))) for i in range(120)]
    docs, planted = [], set()
    for d in range(600):
        text = [rng.choice(common) if rng.random() < 0.5 else f"own{rng.randrange(4000)}" for _ in range(150)]
        if d % 2 == 0:
            i, w = items[rng.randrange(len(items))]
            a = rng.randrange(0, len(w) - 28)
            out = []
            for k, x in enumerate(w[a : a + 28]):
                out.append(f"swap{rng.randrange(9999)}" if rng.random() < 0.08 else x)
                if k % 11 == 10:
                    out.append(f"extra{rng.randrange(9999)}")
            text[60:60] = out
            planted.add((d, i))
        docs.append((d, " ".join(text)))
    dd = spark.createDataFrame(docs, "doc_id bigint, text string")
    ii = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    rows = leaks(dd, ii, PARAPHRASED, True).withColumn("kind", label()).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    told = {(r["doc_id"], r["item_id"]) for r in rows if r["kind"] != "similar"}
    assert len(found & planted) / len(planted) >= 0.9
    assert len(told & planted) / len(planted) >= 0.9 and len(told & planted) / len(told) >= 0.9
