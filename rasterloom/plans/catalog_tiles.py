"""More of the query catalogue: neighbourhoods, regions and watersheds over tiles with a halo."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tiles
from ..sources import cube as source
from .catalog import KEY, _cube, query, r


def _filled(spark, sf_dir):
    """The cube with x (vis, missing as 0), the mask of missing ones, and its profile."""
    cube = _cube(spark, sf_dir).select(*KEY, "vis", "lir", F.coalesce("vis", F.lit(0.0)).alias("x"), F.col("vis").isNull().alias("gone"))
    return cube, source.profile(spark, sf_dir)


_MIRRORED = """
CASE WHEN {i} + {d} < 0 THEN -({i} + {d}) - 1 WHEN {i} + {d} >= side THEN 2 * side - 1 - {i} - {d} ELSE {i} + {d} END"""
_WIDE = f"""x AS (SELECT t, lat_i AS i, lon_i AS j, coalesce(vis, 0.0) AS x, vis IS NULL AS gone FROM cube),
box AS (
  SELECT c.t, c.i, c.j, n.x
  FROM x c, grid, (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx), x n
  WHERE n.t = c.t
    AND n.i = {_MIRRORED.format(i="c.i", d="dy").strip()}
    AND n.j = {_MIRRORED.format(i="c.j", d="dx").strip()}
), masked AS (
  SELECT c.t, c.i, c.j, bool_or(n.gone) AS masked
  FROM x c JOIN x n ON n.t = c.t AND abs(n.i - c.i) + abs(n.j - c.j) <= 1
  GROUP BY ALL
)"""


@query(f"""
WITH {_WIDE}
SELECT box.t, box.i AS lat_i, box.j AS lon_i,
  CASE WHEN any_value(masked) THEN -10.0 ELSE round(sqrt(var_pop(x)), 6) END AS deviation,
  CASE WHEN any_value(masked) THEN -10.0 ELSE round(max(x), 6) END AS greatest
FROM box JOIN masked USING (t, i, j) GROUP BY ALL""")
def masked_boxes(spark, sf_dir):
    """5x5 deviation and maximum, edges mirrored, -10 on and beside missing cells."""
    cube, p = _filled(spark, sf_dir)
    out = tiles.local_max(tiles.local_std(cube, "x", "deviation", 5, "gone", p), "x", "greatest", 5, "gone", p)
    return out.select(*KEY, r("deviation").alias("deviation"), r("greatest").alias("greatest"))


@query("""
WITH x AS (SELECT t, lat_i AS i, lon_i AS j, vis AS x FROM cube WHERE vis IS NOT NULL),
p AS (
  SELECT c.t, c.lat_i, c.lon_i, ((n.t - c.t + 1) * 3 + n.i - c.lat_i + 1) * 3 + n.j - c.lon_i + 1 AS place, n.x
  FROM cube c JOIN x n ON abs(n.t - c.t) <= 1 AND abs(n.i - c.lat_i) <= 1 AND abs(n.j - c.lon_i) <= 1
)
SELECT t, lat_i, lon_i, count(x) AS n, round(coalesce(sum((place + 1) * (x + 1)), 0.0) - 378, 6) + 0.0 AS checked
FROM (SELECT t, lat_i, lon_i FROM cube) LEFT JOIN p USING (t, lat_i, lon_i) GROUP BY ALL""")
def time_patches(spark, sf_dir):
    """3x3x3 patches over time and space: values that are there, and the sum of all weighted by their places (missing: -1)."""
    found = tiles.patches(_cube(spark, sf_dir), "vis", "p", (3, 3, 3))
    weighted = F.aggregate(F.transform("p", lambda v, i: (i + 1) * v), F.lit(0.0), lambda a, v: a + v)
    there = F.size(F.filter("p", lambda v: v != -1.0)).cast("long")
    return found.select(*KEY, there.alias("n"), r(weighted).alias("checked"))


@query("""
WITH RECURSIVE s AS (SELECT t, lat_i AS i, lon_i AS j FROM cube WHERE vis > 0.25),
reach AS (SELECT t, i, j, i AS y, j AS x FROM s UNION SELECT r.t, r.i, r.j, s.i, s.j FROM reach r JOIN s ON s.t = r.t AND abs(s.i - r.y) + abs(s.j - r.x) = 1),
m AS (SELECT t, i, j, min(y * side + x) AS first FROM reach, grid GROUP BY ALL)
SELECT t, i AS lat_i, j AS lon_i, CAST(dense_rank() OVER (PARTITION BY t ORDER BY first) AS INTEGER) AS region FROM m""")
def bright_regions(spark, sf_dir):
    cube = _cube(spark, sf_dir).withColumn("bright", F.coalesce(F.col("vis") > 0.25, F.lit(False)))
    return tiles.numbered(tiles.regions(cube, "bright"))


@query("""
WITH RECURSIVE s AS (SELECT t, lat_i AS i, lon_i AS j FROM cube WHERE vis > 0.6),
reach AS (
  SELECT t, i, j, t AS u, i AS y, j AS x FROM s
  UNION SELECT r.t, r.i, r.j, s.t, s.i, s.j FROM reach r JOIN s ON abs(s.t - r.u) + abs(s.i - r.y) + abs(s.j - r.x) = 1
)
SELECT t, i AS lat_i, j AS lon_i, min((u::BIGINT * 1048576 + y) * 1048576 + x) AS first FROM reach GROUP BY t, i, j""")
def bright_volumes(spark, sf_dir):
    """Regions of bright cells through space and time, by the number of their first cell."""
    cube = _cube(spark, sf_dir).withColumn("bright", F.coalesce(F.col("vis") > 0.6, F.lit(False)))
    return tiles.regions(cube, "bright", over_time=True).select(*KEY, "first")


@query()
def watershed_volume(spark, sf_dir):
    """The rim of what is not bright, through space and time; held against a plain version in the tests."""
    cube = _cube(spark, sf_dir).withColumn("dim", F.coalesce(F.col("vis") < 0.6, F.lit(True)))
    return tiles.watershed_volume(cube, "dim")
