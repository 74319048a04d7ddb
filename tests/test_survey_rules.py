"""Queries against SQL written from SURVEY's rules, where the registered SQL keeps a shorter form."""

import duckdb
from rasterloom.plans import catalog

SF = "/root/testdata/sf0.01"

#: V3: each pair of days at most two apart, three for the days 2 to n - 3 of n = 30; a missing value gives -10.
TOTAL = f"""WITH {catalog._BASE}, pairs AS (
  SELECT a.t, a.lat_i, a.lon_i, coalesce(abs(a.vis - b.vis), -10.0) AS d
  FROM cube a JOIN cube b ON a.lat_i = b.lat_i AND a.lon_i = b.lon_i AND a.slot = b.slot AND a.dfb <> b.dfb
    AND abs(a.dfb - b.dfb) <= CASE WHEN a.dfb - 16071 BETWEEN 2 AND 30 - 3 THEN 3 ELSE 2 END
) SELECT t, lat_i, lon_i, round(min(d), 6) + 0.0 AS total FROM pairs GROUP BY ALL"""


def differing(spark, name, column, sql):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for table in ("events", "customer", "orders"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = {tuple(r[:3]): r[3] for r in db.execute(sql).fetchall()}
    got = {(r.t, r.lat_i, r.lon_i): r[column] for r in catalog.QUERIES[name](spark, SF).collect()}
    assert set(got) == set(want) and len(want) == 120 * 6 * 6  # cells: 10,000 events, 250 a cell
    near = lambda a, b: a == b or (isinstance(a, float) and abs(a - b) < 2e-6)
    return [k for k in want if not near(got[k], want[k])]


def test_total_variability(spark):
    assert differing(spark, "lasting_variability", "total", TOTAL) == []
