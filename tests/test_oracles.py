"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

from tools.check_oracles import TABLES, norm, type_diffs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _names():
    from __spark_entry__ import oracle_sql

    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries

    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    rel = duck.sql(oracle_sql()[name])
    assert type_diffs(df.schema, rel.columns, rel.types) == []
    cur = duck.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == cols
    idx = [ocols.index(c) for c in cols]
    want = sorted(repr(tuple(norm(r[i]) for i in idx)) for r in cur.fetchall())
    assert got == want


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    rows = entry(spark).collect()
    assert len(rows) > 0 and set(rows[0].asDict()) == {"lang", "documents", "chunks", "avg_chunk_chars"}
