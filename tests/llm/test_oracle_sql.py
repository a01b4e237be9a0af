"""The corpus queries that have SQL twins against them, on whole tables."""

import duckdb
import pytest

from rewind.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name, sf):
    path = f"/root/testdata/{sf}"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = duck.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, path)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    theirs = sorted(want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall(), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr) == theirs and theirs
