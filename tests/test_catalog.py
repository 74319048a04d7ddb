"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest
from rasterloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    say = lambda v: "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(say(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.execute(catalog.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
