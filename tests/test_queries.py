"""Every query against its SQL on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = {n for m in entry.MODULES for n in m.QUERIES}


def canonical(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, Decimal):
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.sql(sql)
    cols, found = out.columns, out.fetchall()
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    ours = sorted(repr(tuple(canonical(r[c]) for c in order)) for r in rows)
    theirs = sorted(repr(tuple(canonical(r[cols.index(c)]) for c in order)) for r in found)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
