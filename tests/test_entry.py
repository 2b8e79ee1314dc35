import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p2_found", "p4_found", "pair_counts", "state_family_kt"} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).columns == ["kind", "key_value"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")
@pytest.mark.parametrize("name", ["pair_counts", "ctw_kt_d2", "chunked_kt", "event_pairs", "p2_contexts", "streaming_counts", "tokenizer_roundtrip"])
def test_some_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    norm = lambda rows: sorted(tuple(round(v, 3) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert norm(map(tuple, got.select(*columns).collect())) == norm(want.fetchall())
