"""The SQL of these queries against them, on the smallest tables."""

import duckdb
import pytest

from riskloom.llm import queries

SF = "/root/testdata/sf0.001"


def canonical(value):
    return f"{value:.9g}" if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.sql(queries.SQL[name])
    order = sorted(df.columns)
    assert sorted(out.columns) == order
    places = [out.columns.index(c) for c in order]
    assert sorted(repr([canonical(r[c]) for c in order]) for r in df.collect()) == sorted(repr([canonical(r[i]) for i in places]) for r in out.fetchall())
