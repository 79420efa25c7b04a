"""Every query with SQL gives the same rows as DuckDB does."""

import os

import duckdb
import pytest

from loreloom import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def cell(x):
    return f"{x:.4f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rel = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = sorted(got.columns)
    at = [rel.columns.index(c) for c in order]
    expected = sorted(tuple(cell(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(cell(r[c]) for c in order) for r in got.collect()) == expected
    assert expected
