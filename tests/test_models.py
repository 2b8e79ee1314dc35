import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.functions import layered, moments
from tallyflow.functions.special import LN2, kt_state_bits, lgamma, log2_choose
from tallyflow.operators import context_tree, counting, entropy, families, ordered, pooled, profiles, sampling, tokenizer, vocabulary


def stream(spark, texts):
    return spark.createDataFrame([(i, list(t)) for i, t in enumerate(texts)], "doc_id bigint, syms array<string>")


def ranked(df, columns, order):
    for c in columns:
        e = F.lit(None).cast("int")
        for i, s in enumerate(order):
            e = F.when(F.col(c) == s, i).otherwise(e)
        df = df.withColumn(c, e)
    return df


TEXTS = ["abcabdabcabd" * 8 + "a", "", "a", "ddc", "abcabc" * 5]


def test_lgamma(spark):
    xs = [0.5, 1.0, 2.5, 10.0, 1234.5, 1e6, 1e12]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(lgamma(F.col("x")).alias("g")).collect()
    for x, r in zip(xs, got):
        assert r["g"] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-11)
    assert log2_choose(5, 2) == pytest.approx(math.log2(10))


def test_context_counts_equal_loops(spark):
    s = stream(spark, TEXTS)
    for lags, start in (([1], 1), ([1, 2], 2), ([2], 3), ([], 0)):
        want = {}
        for t in TEXTS:
            for i in range(start, len(t)):
                k = (t[i], *[t[i - d] for d in lags])
                want[k] = want.get(k, 0) + 1
        rows = counting.shifted(s, lags, start)
        names = ["y", *[f"x{i}" for i in range(1, len(lags) + 1)]]
        got = {tuple(r[n] for n in names): r["n"] for r in rows.groupBy(*names).agg(F.count("*").alias("n")).collect()}
        assert got == want


def test_nodes_conserve_counts(spark):
    nodes = counting.context_nodes(counting.context_counts(stream(spark, TEXTS), [1, 2]), 2)
    sums = {r["d"]: r["n"] for r in nodes.groupBy("d").agg(F.sum("n").alias("n")).collect()}
    assert set(sums.values()) == {sum(max(0, len(t) - 2) for t in TEXTS)}


def test_blocks_add_up(spark):
    s = stream(spark, TEXTS)
    deltas = counting.interval_counts(s, [1], [1, 4, 9, 1000])
    direct = counting.context_counts(s, [1])
    upto = counting.cumulative_counts(deltas, ["y", "x1"], [1, 2, 3]).filter("checkpoint = 3")
    assert counting.audit_counts(upto, direct, ["y", "x1"]).count() == 0
    assert counting.audit_counts(deltas.filter("checkpoint = 1").drop("checkpoint"), direct, ["y", "x1"]).count() > 0
    merged = counting.merge_counts(deltas.filter("checkpoint = 1"), deltas.filter("checkpoint > 1"), ["y", "x1"])
    assert counting.audit_counts(merged, direct, ["y", "x1"]).count() == 0


def test_blocks_reach_the_end_of_long_texts(spark, tmp_path):
    from tallyflow.plans import checkpoint_queries, count_queries, pair_queries

    spark.createDataFrame([(1, "a1" * 50_100), (2, "b,"), (3, None), (4, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    total = lambda df: df.agg(F.sum("n")).first()[0]
    queries, d = {**count_queries.QUERIES, **pair_queries.QUERIES}, str(tmp_path)
    assert total(queries["count_delta"](spark, d)) == total(queries["count_merge"](spark, d)) == 100_198
    assert total(queries["count_cumulative"](spark, d).filter("checkpoint = 4")) == 100_198
    assert queries["audit_counts"](spark, d).count() == 0
    assert total(checkpoint_queries._blocks(spark, d)) == 100_198
    assert {r["n_coded"] for r in queries["chunked_kt"](spark, d).collect()} == {100_198}
    assert {r["n_coded"] for r in queries["pooled_counts_mix"](spark, d).collect()} == {100_198}


def test_mass_quantiles_over_the_whole_vocabulary(spark):
    rng = random.Random(4)
    for sizes in ([1] * 300, [rng.randrange(1, 9) for _ in range(200)] + [500, 90, 90], [7], [10, 10, 10, 10]):
        total, want = sum(sizes), {}
        for share in (0.5, 0.9, 0.99):
            upto = list(itertools.accumulate(sorted(sizes, reverse=True)))
            want[share] = next(k for k, u in enumerate(upto, 1) if u >= share * total)
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "sym string, n bigint")
        assert {r["share"]: r["ranks"] for r in entropy.mass_quantiles(df).collect()} == want
    assert entropy.mass_quantiles(df.filter("n < 0")).collect() == []


def test_layered_queries_average_over_all_depths(spark, tmp_path):
    from tallyflow.plans import layered_queries

    spark.createDataFrame([(1, "ab ab ba ab " * 3)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    syms = ["ab", " ", "ab", " ", "ba", " ", "ab", " "] * 3
    after = {}
    for x, y in zip(syms, syms[1:]):
        after.setdefault(x, {}).setdefault(y, 0)
        after[x][y] += 1
    rank = {" ": 0, "ab": 1, "ba": 2}
    want = {(rank[x], c): p for x, ys in after.items() for c, p in layered.predictive(list(ys.values()), 65).items()}
    got = {(r["x1"], r["c"]): r["p"] for r in layered_queries.QUERIES["layered_predictive"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want)
    assert layered.default_depths(65) == 20

    def at(context):
        """Successors of a context, nearest symbol first, over positions that have two symbols before them."""
        counts = {}
        for i in range(2, len(syms)):
            if tuple(syms[i - k - 1] for k in range(len(context))) == context:
                counts[syms[i]] = counts.get(syms[i], 0) + 1
        return layered.log2_q(list(counts.values()), 65) if counts else None

    def beta(context):
        own = at(context)
        if own is None:
            return 0.0
        return own if len(context) == 2 else np.logaddexp2(own, sum(beta((*context, s)) for s in sorted(set(syms)))) - 1

    tree = layered_queries.QUERIES["layered_tree"](spark, str(tmp_path)).first()
    assert tree["tree_bits"] == pytest.approx(-beta(()), abs=2e-3)
    family = {r["m"]: r["bits"] for r in layered_queries.QUERIES["layered_state_family"](spark, str(tmp_path)).collect()}
    assert family[64] == pytest.approx(-sum(layered.log2_q(list(ys.values()), 65) for ys in after.values()), abs=2e-3)
    products = {(r["m1"], r["m2"]): r["bits"] for r in layered_queries.QUERIES["layered_product_family"](spark, str(tmp_path)).collect()}
    assert products[16, 0] == pytest.approx({r: b for r, b in family.items()}[16], abs=2e-3)


def test_family_identities(spark):
    # The last symbol alone leaves the next one open, the last two settle it.
    s = stream(spark, ["aabb" * 60 + "a", "", "cd"])
    pairs = ranked(counting.context_counts(s, [1], 2), ["y", "x1"], "abcd")
    triples = ranked(counting.context_counts(s, [1, 2]), ["y", "x1", "x2"], "abcd")
    state = {r["m"]: r for r in families.mixture(families.member_bits(families.state_members(pairs, [0, 2, 4]), ["m"], ["state"], 5), ["m"]).collect()}
    product = {(r["m1"], r["m2"]): r for r in families.member_bits(families.product_members(triples, [(0, 0), (2, 0), (4, 4)]), ["m1", "m2"], ["s1", "s2"], 5).collect()}
    # (M, 0) is first order; M = 0 is memoryless.
    assert product[2, 0]["bits"] == pytest.approx(state[2]["bits"])
    assert product[0, 0]["bits"] == pytest.approx(state[0]["bits"])
    assert product[4, 4]["bits"] < state[4]["bits"]
    best = min(r["bits"] for r in state.values())
    assert best <= state[0]["family_bits"] + 1e-9 <= best + math.log2(3) + 1e-9
    assert sum(r["posterior"] for r in state.values()) == pytest.approx(1)


def test_kt_is_the_sequential_code(spark):
    seq = "abacabadab"
    bits, seen = 0.0, {}
    for i, c in enumerate(seq):
        bits -= math.log2((seen.get(c, 0) + 0.5) / (i + 2.5))
        seen[c] = seen.get(c, 0) + 1
    df = spark.createDataFrame(list(seen.items()), "y string, n bigint")
    assert df.agg(kt_state_bits("n", 5).alias("b")).first()["b"] == pytest.approx(bits)


def test_context_tree_equals_recursion(spark):
    text = "abcabdabcabdcabdab"
    nodes = counting.context_nodes(counting.context_counts(stream(spark, [text]), [1, 2]), 2)
    scored = context_tree.node_bits(nodes, 2, 4)
    weighed = context_tree.weigh(scored, 2)
    got = context_tree.tree_summary(weighed).first()

    def counts(ctx):
        c = {}
        for i in range(2, len(text)):
            if all(text[i - 1 - k] == x for k, x in enumerate(ctx)):
                c[text[i]] = c.get(text[i], 0) + 1
        return c

    def q(ctx):
        c = counts(ctx)
        n = sum(c.values())
        return (math.lgamma(2) - math.lgamma(n + 2) + sum(math.lgamma(m + 0.5) - math.lgamma(0.5) for m in c.values())) / LN2

    def beta(ctx, best):
        if len(ctx) == 2:
            return q(ctx)
        kids = sum(beta((*ctx, x), best) for x in "abcd" if counts((*ctx, x)))
        return max(q(ctx), kids) - 1 if best else math.log2(2.0 ** q(ctx) / 2 + 2.0**kids / 2)

    assert got["tree_bits"] == pytest.approx(-beta((), False))
    assert got["map_bits"] == pytest.approx(-beta((), True))
    leaves = context_tree.map_leaves(weighed, 2).collect()
    assert sum(r["n"] for r in leaves) == len(text) - 2
    fixed = {r["d"]: r for r in context_tree.fixed_depths(scored).collect()}
    assert all(r["n_coded"] == len(text) - 2 for r in fixed.values())


def test_entropies(spark):
    pairs = counting.context_counts(stream(spark, TEXTS), [1])
    h = entropy.conditional_entropy(pairs, "x1").first()
    mi = entropy.mutual_information(pairs, "y", "x1").first()
    y = entropy.entropy(pairs.groupBy("y").agg(F.sum("n").alias("n"))).first()
    assert mi["bits"] == pytest.approx(y["bits"] - h["bits"])
    assert entropy.entropy(spark.createDataFrame([("a", 4), ("b", 4)], "s string, n bigint")).first()["bits"] == pytest.approx(1)


@pytest.mark.parametrize("profile,d", [([3, 2, 1], 25), ([20, 5, 1], 500), ([500, 30, 2], 1000), ([5000, 300, 20], 4096), ([1], 7), ([2, 1], 3)])
def test_layered_predictive_is_a_law(profile, d):
    p = layered.predictive(profile, d, 4)
    total = sum(p[c] for c in profile) + (d - len(profile)) * p.get(0, 0.0)
    assert total == pytest.approx(1, abs=1e-8)


def test_layered_small_cases():
    assert layered.log2_q([], 9) == 0 or layered.log2_q([], 9) == pytest.approx(0)
    assert layered.log2_q([1], 9) == pytest.approx(-math.log2(9))
    # All sequences of length 3 over 2 symbols: probabilities add up to one.
    total = sum(2.0 ** layered.log2_q([c for c in (s.count("a"), s.count("b")) if c], 2, 5) for s in map("".join, itertools.product("ab", repeat=3)))
    assert total == pytest.approx(1, abs=1e-9)
    assert layered.default_depths(1) == 1
    assert layered.depth_posterior([5, 1], 10, 4).sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        layered.log2_q([1, 1, 1], 2)


def test_moments_equal_plain_sums_layer_by_layer():
    step = 0.02
    v = np.arange(-2500, 400) * step
    u = np.arange(-5000, 2000) * step
    for r in (0, 3, 40):
        kernel = (r + 1) * v - np.exp(v)
        last = math.lgamma(r + 1) - (r + 1) * np.logaddexp(0, u)
        scorer = layered.Scorer(9, 3, layered._direct(3))
        for layer in (2, 3):
            at = np.arange(2600, 5600, 300)
            part = np.array([last[i - 2500 : i + 400] + kernel for i in at])
            want = part.max(1) + np.log(step * np.exp(part - part.max(1, keepdims=True)).sum(1))
            got = scorer._ln_phi(np.tile(u[at], (2, 1)), np.array([r]))[layer - 2, :, 0]
            assert np.allclose(got, want, atol=1e-7)
            full = np.full(len(u), np.nan)
            for i in range(2500, len(u) - 400):
                p = last[i - 2500 : i + 400] + kernel
                full[i] = p.max() + math.log(step * np.exp(p - p.max()).sum())
            # Left of what was computed ln phi is constant, right of it unused.
            full[:2500] = (layer) * math.lgamma(r + 1)
            full[len(u) - 400 :] = full[len(u) - 401]
            last = full


def test_a_distributed_table_gives_what_single_columns_give(spark):
    table = moments.build_distributed(spark, 4, 5000)
    for profile, d in (([4000, 300, 77, 23, 24, 1, 1], 64), ([1, 1], 5)):
        counts, symbols = np.unique(profile, return_counts=True)
        assert np.allclose(layered.Scorer(d, 4, table).levels(counts, symbols), layered.log2_q_levels(profile, d, 4), atol=1e-6)


def test_layered_states(spark):
    pairs = counting.context_counts(stream(spark, TEXTS), [1])
    got = layered.state_bits(profiles.state_classes(pairs, ["x1"]), [], 5, 3).first()
    want = sum(-layered.log2_q(list(r["profile"]), 5, 3) for r in profiles.state_profiles(pairs, ["x1"]).collect())
    assert got["bits"] == pytest.approx(want)


def test_augment(spark):
    df = spark.createDataFrame([([3, 1, 1],)], "p array<bigint>")
    got = df.select(*[profiles.augment(F.col("p"), F.lit(c).cast("bigint")).alias(f"a{c}") for c in (0, 1, 3, 9)]).first()
    assert list(got) == [[3, 1, 1, 1], [3, 2, 1], [4, 1, 1], [3, 1, 1]]


def test_vocabulary_ties(spark):
    s = stream(spark, ["bbaaccd"])
    v = vocabulary.top_symbols(s, 2, "doc_id").orderBy("rank").collect()
    assert [r["sym"] for r in v] == ["b", "a"]
    hidden = vocabulary.escape_payload(counting.symbol_counts(s), vocabulary.top_symbols(s, 2, "doc_id")).collect()
    assert {r["sym"]: r["n"] for r in hidden} == {"c": 2, "d": 1}


def test_ordered_lags_across_chunks(spark):
    rows = [(0 if i % 3 else i % 5, i // 2, i, f"s{i % 4}") for i in range(400)]
    df = spark.createDataFrame(rows, "u bigint, t bigint, e bigint, s string").repartition(7)
    got = {(r["u"], r["e"]): (r["x1"], r["x2"]) for r in ordered.lagged_rows(df, ["u"], ["t", "e"], "s", 2).collect()}
    assert len(got) == 400
    for u in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == u), key=lambda r: r[1:3])
        for i, r in enumerate(own):
            assert got[u, r[2]] == (own[i - 1][3] if i > 0 else None, own[i - 2][3] if i > 1 else None)
    assert ordered.lagged_rows(df.filter("u = 99"), [], ["e"], "s", 1).count() == 0


def test_pooled_one_hot_members_agree(spark):
    s = stream(spark, ["abcabdabcabdabcabddcba"] * 3)
    v = vocabulary.top_symbols(s, 3, "doc_id")
    edges = [2, 8, 100]
    q0, laws = pooled.expert_laws(pooled.prefix_tables(s, v, 3, [1, 2], edges), [1, 2], 4)
    assert all(abs(r["s"] - 1) < 1e-9 for r in q0.groupBy("checkpoint").agg(F.sum("q0").alias("s")).collect())
    experts = pooled.expert_columns(pooled.block_cells(s, v, 3, [1, 2], edges), q0, laws, [1, 2])
    mix = {r["member"]: r["bits"] for r in pooled.mixture_members(experts, [[0, 1.0, 0], [0, 0, 1.0]]).collect()}
    prod = {r["member"]: r["bits"] for r in pooled.product_members(experts, q0, laws, [1, 2], [[1.0, 0], [0, 1.0]]).collect()}
    assert prod[0] == pytest.approx(mix[0]) and prod[1] == pytest.approx(mix[1])


def test_edges():
    assert pooled.equal_edges(0, 10, 4) == [0, 2, 5, 7, 10]
    e = pooled.geometric_edges(2, 1000, 6)
    assert e[0] == 2 and e[-1] == 1000 and all(a < b for a, b in zip(e, e[1:]))


@pytest.mark.parametrize("numbers", ["intern", "compositional"])
@pytest.mark.parametrize("case", ["conditioned", "folded"])
def test_tokenizer_round_trip(numbers, case):
    rng = np.random.default_rng(3)
    cases = [b"", b"abc", b"Cap UPPER camelCase A a iPhone iPhone", b"2024-01-02 10:11 007 7", "né 中文 ”x”".encode(), bytes(range(256)), b"the The THE tHe the" * 5]
    cases += [rng.integers(0, 256, 5000, dtype=np.uint8).tobytes() for _ in range(3)]
    for raw in cases:
        enc = tokenizer.encode_bytes(raw, numbers, case)
        assert tokenizer.decode_bytes(enc, case) == raw
        assert enc["tokens"][-1] == tokenizer.END
        assert enc["tokens"].count(tokenizer.WORD) + enc["tokens"].count(tokenizer.NUMBER) == len(enc["spellings"])


def test_design_and_estimates(spark):
    anchors = sampling.design_anchors(1_000_000, 2050, 4096, 8, 24, 2)
    assert len(anchors) == 64
    assert sum(a.weight for a in anchors) == pytest.approx(1_000_000 - 4096 + 1 - 2050)
    # The early strata end a twentieth of all positions after the least prefix.
    assert anchors[16].start == 2050 + 50_000 and anchors[0].start == 2050
    fit = sampling.zero_age([(0, 10, 10, 1.0 + 2 * 0.045), (10, 40, 30, 1.0 + 2 * 0.245), (40, 100, 60, 1.0 + 2 * 0.695)], 100)
    assert fit["linear"] == pytest.approx(1.0) and fit["quadratic"] == pytest.approx(1.0)
    values = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 10.0)], "stratum int, value double")
    sizes = spark.createDataFrame([(1, 10), (2, 30)], "stratum int, size bigint")
    est = sampling.stratified_estimate(values, sizes).first()
    assert est["estimate"] == pytest.approx((10 * 3 + 30 * 10) / 40)
    assert est["standard_error"] == pytest.approx(math.sqrt(100 * 0.8 * 2 / 2) / 40)
    boot = sampling.bootstrap_interval(values, sizes, 200).first()
    assert boot["low"] <= est["estimate"] <= boot["high"]


def test_decay_and_search():
    c, a, s = sampling.decay_with_offset([1, 2, 4, 8, 16], [0.3 + 2 * x**-1.0 for x in (1, 2, 4, 8, 16)], 2000)
    assert c == pytest.approx(0.3, abs=0.01) and s == pytest.approx(-1, abs=0.05)
    best, known = sampling.lattice_search((128, 128, 0), lambda p: (math.log2(p[0]) - 6) ** 2 + abs(p[1] - 32) + abs(p[2] - 4), (64, 0, 0), (256, 256, 256), lambda p: p[2] <= p[1] <= p[0])
    assert best == (64, 32, 4)
    assert known[128, 128, 0] >= known[best]
