"""Operators that SQL can express, against it."""

import duckdb
import pytest
from corpusloom.llm import registry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = registry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    found = con.sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[k] for k in places) for r in found.fetchall())
