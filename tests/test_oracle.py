"""Every query with a SQL twin gives the twin's rows."""

import math

import duckdb
import pytest

from rewind.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    theirs = sorted((tuple(plain(v) for v in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in order]).fetchall()), key=repr)
    assert mine == theirs


def test_golden_counts(spark):
    assert QUERIES["ww_conflicts"](spark, SF).count() == 201
    assert QUERIES["rw_edges_best"](spark, SF).groupBy("granularity").count().collect() == [("tuple", 59)]
    classes = {r[0]: r[1] for r in QUERIES["classify_all"](spark, SF).groupBy("classification").count().collect()}
    assert classes == {"dependent": 135, "clean": 115}
    assert QUERIES["as_of_state"](spark, SF).count() == 360
