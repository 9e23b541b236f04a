"""The pN_ queries against their DuckDB statements on the smallest tables."""

import os

import duckdb
import pytest

from phytomill.llm import oracle, queries

SF = "/root/testdata/sf0.001"


def form(value):
    return f"{value:.5f}" if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    theirs = con.sql(oracle.ORACLE[name])
    ours = queries.QUERIES[name](spark, SF)
    assert sorted(ours.columns) == sorted(theirs.columns)
    order = [theirs.columns.index(c) for c in sorted(theirs.columns)]
    want = sorted(tuple(form(r[i]) for i in order) for r in theirs.fetchall())
    assert sorted(tuple(form(r[c]) for c in sorted(ours.columns)) for r in ours.collect()) == want
