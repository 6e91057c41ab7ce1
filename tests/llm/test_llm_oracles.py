import duckdb
import pytest
from conftest import SF001

from chunkmill.llm import queries


def rows(cols, values):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in values), key=lambda r: tuple(map(str, r))), cols


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, SF001)
    cols = sorted(df.columns)
    got = rows(cols, [tuple(r) for r in df.select(*cols).collect()])
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    assert got == rows(cols, rel.select(", ".join(cols)).fetchall())
