import datetime as dt
import json
import random

import pandas as pd

from tallyflow.operators import schema_drift
from tallyflow.operators.schema_drift import _beginning, compose, consistent_table, drift_report, fuse, fused_schema, leaves_of, one_file, wide_table

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "file_id bigint, series_id bigint, written_at timestamp, received_at timestamp, payload string, path string"


def files(spark, rows):
    return spark.createDataFrame([(f, s, None if t is None else T0 + dt.timedelta(hours=t), T0, p, "clash") for f, s, t, p in rows], SCHEMA)


def changes(df):
    return sorted((r["series_id"], r["file_id"], r["change_kind"], r["field_before"], r["field_after"]) for r in df.collect())


def test_leaves():
    assert leaves_of('{"a": 1, "b": {"c": 1.0, "d": null}, "e": [1, {"x": 2}], "f": true, "g": "t", "h": {}}') == [
        ("a", "integer", "1"), ("b.c", "decimal", "1.0"), ("b.d", "null", None), ("e", "list", '[1, {"x": 2}]'), ("f", "flag", "true"), ("g", "text", "t"),
    ]
    for bad in (None, "", " ", "{", "[1]", '"x"', '{"a": NaN}', '{"a": 1'):
        assert leaves_of(bad) is None
    assert leaves_of("{}") == []
    assert leaves_of('{"a": 1e3}')[0][1] == "decimal"


def test_changes_of_a_series(spark):
    rows = [
        (1, 7, 0, '{"degree": 10, "cut": 0.5, "x": 1}'),
        (3, 7, 2, '{"deg": 10, "cut": "0.5", "x": null}'),
        (2, 7, 1, "{broken"),
        (4, 7, 3, '{"deg": 10, "x": 2.0, "cfg": {"cut": 0.5}}'),
        (5, 8, 0, '{"a": 1}'),
    ]
    got = changes(drift_report(files(spark, rows + rows[:1])))
    assert got == [
        (7, 3, "renamed", "degree", "deg"), (7, 3, "retyped", "cut", "cut"),
        (7, 4, "added", "", "cfg.cut"), (7, 4, "removed", "cut", ""), (7, 4, "retyped", "x", "x"),
    ]


def test_hot_series_gives_the_same_in_chunks_of_any_size(spark):
    rng = random.Random(5)
    rows = []
    for f in range(240):
        s = 1 if f % 3 else rng.randrange(2, 9)
        fields = {n: rng.choice([1, 2, 2.5, None, "t", [1], True]) for n in rng.sample(["a", "b", "c", "d", "e"], rng.randrange(0, 5))}
        rows.append((f, s, rng.randrange(400), json.dumps(fields)))
    whole = changes(drift_report(files(spark, rows)))
    assert len(whole) > 200
    for size in (1, 7, 50):
        assert changes(drift_report(files(spark, rows), chunk_files=size)) == whole


def test_nulls_and_empty(spark):
    assert drift_report(files(spark, [])).collect() == []
    assert fused_schema(files(spark, [])).collect() == []
    rows = [(1, None, None, '{"a": 1}'), (2, None, 0, '{"b": "x"}'), (None, 1, 0, '{"a": 1}'), (4, 1, 1, None), (5, 1, None, "")]
    got = {(r["file_id"], r["change_kind"], r["field_before"], r["field_after"]) for r in drift_report(files(spark, rows)).collect()}
    assert got == {(2, "added", "", "b"), (2, "removed", "a", "")}


def test_fused_schema_and_table(spark):
    rows = [(1, 1, 0, '{"a": 1, "b": "7"}'), (2, 1, 1, '{"a": 1.5, "b": [3]}'), (3, 1, 2, '{"a": null, "b": true}')]
    schema = {(r["path"], r["tag"]): (r["files"], r["canonical"]) for r in fused_schema(files(spark, rows)).collect()}
    assert schema == {("a", "integer"): (1, "decimal"), ("a", "decimal"): (1, "decimal"), ("a", "null"): (1, "decimal"), ("b", "text"): (1, "text"), ("b", "list"): (1, "text"), ("b", "flag"): (1, "text")}
    table = {(r["file_id"], r["path"]): r for r in consistent_table(files(spark, rows)).collect()}
    assert table[1, "a"]["as_integer"] == 1 and table[2, "a"]["as_decimal"] == 1.5 and table[2, "a"]["as_integer"] is None
    assert [table[f, "b"]["canonical_number"] for f in (1, 2, 3)] == [7.0, 3.0, 1.0]
    assert table[3, "a"]["canonical_number"] is None


def test_renamed_fields_go_on_under_their_first_name_in_chunks_of_any_size(spark):
    rows = [(1, 1, 0, '{"degree": 10}'), (2, 1, 1, '{"deg": 10, "x": null}'), (3, 1, 2, '{"deg": null, "x": 123456789012345678901234567890}'), (4, 1, 3, '{"d": 10, "x": 2}'), (5, 1, 4, '{"x": 2, "degree": 11}'), (6, 2, 0, '{"d": 1}')]
    for size in (1, 2, 100):
        table = {(r["file_id"], r["path"]): r for r in consistent_table(files(spark, rows), size).collect()}
        assert {k: r["field"] for k, r in table.items() if k[1] != "x"} == {(1, "degree"): "degree", (2, "deg"): "degree", (3, "deg"): "degree", (4, "d"): "degree", (5, "degree"): "degree", (6, "d"): "d"}
        assert table[3, "x"]["lexeme"] == "123456789012345678901234567890" and table[3, "x"]["as_integer"] is None
    wide = {r["file_id"]: r for r in wide_table(consistent_table(files(spark, rows))).collect()}
    assert [wide[f]["degree"] for f in range(1, 7)] == [10.0, 10.0, None, 10.0, None, None] or wide[5]["degree"] == 11.0


def leaves_at_random(rng, nulls):
    pick = lambda: ("null", None) if rng.random() < nulls else rng.choice([("integer", "10"), ("decimal", "10.0"), ("integer", "20"), ("text", "t")])
    return {n: pick() for n in "abcd" if rng.random() < 0.85}


def held(state):
    """Field and alternative of each path, as if nothing preceded."""
    return state and {p: (b[0], b[3], b[4]) for p, b in compose(None, state)["pieces"][-1]["union"].items()}


def test_segments_compose_in_any_grouping():
    rng = random.Random(6)
    for _ in range(300):
        series, parts, start = 1, [], 0
        for i in range(12):
            if rng.random() < 0.1:
                series, start = series + 1, i
            parts.append(one_file(series, leaves_at_random(rng, 0.6)))
        union = None
        for x in parts[start:]:
            leaves = x["pieces"][0]["first"]
            union = _beginning(leaves, True) if union is None else fuse(union, leaves)[0]

        def grouped(lo, hi):
            if hi - lo == 1:
                return parts[lo]
            cut = rng.randrange(lo + 1, hi)
            return compose(grouped(lo, cut), grouped(cut, hi))

        assert held(grouped(0, 12)) == {p: (b[0], b[3], b[4]) for p, b in union.items()}


def test_rounds_of_states_give_what_precedes_each_chunk(monkeypatch):
    monkeypatch.setattr(schema_drift, "FAN_IN", 3)
    rng = random.Random(7)
    for _ in range(40):
        # One series throughout, with fields that stay null over several chunks.
        parts = [one_file(1, leaves_at_random(rng, 0.7)) for _ in range(25)]
        want, union = [], None
        for x in parts:
            leaves = x["pieces"][0]["first"]
            want.append(union and {p: (b[0], b[3], b[4]) for p, b in union.items()})
            union = _beginning(leaves, True) if union is None else fuse(union, leaves)[0]
        level, got = pd.DataFrame({"chunk": range(25), "state": [json.dumps(x) for x in parts]}), []
        while True:
            done = pd.concat([schema_drift._round(g) for _, g in level.groupby(level["chunk"] // 3)])
            got.append(done[~done["whole"]])
            if len(level) <= 3:
                break
            level = done[done["whole"]]
        above = got.pop().set_index("chunk")["state"].to_dict()
        while got:
            own = got.pop()
            rows = own.assign(above=[above[c // 3] for c in own["chunk"]])
            above = pd.concat(schema_drift._join_states(iter([rows]))).set_index("chunk")["state"].to_dict()
        assert [held(json.loads(above[c]) if above[c] else None) for c in range(25)] == want
