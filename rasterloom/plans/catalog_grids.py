"""More of the query catalogue: operators on whole slots, the segmentation tree, warm ground and lags."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import classify, grids, stats
from ..sources import cube as source
from .catalog import _INDEXED, KEY, _bt, _cube, _test, query

_RISES, _FALLS = (f"greatest(0.0, {', '.join(s.format(f'n{k}{c}') for k in (1, 2) for c in 'ae')})" for s in ("ndsi - {}", "{} - ndsi"))
_GRAYS = ("ndsi", "vis", "cli_eps", "rises", "falls", "cli")


@query(f"""
WITH {_INDEXED}, f AS (SELECT t, lat_i, lon_i, ndsi, vis, cli_eps, cli, sea_coast, {_RISES} AS rises, {_FALLS} AS falls, dawn_day AND {_test(f"{_bt(12.4e-6, 0.85)} - lir > 8")} AS cold,
  mir IS NULL OR lir IS NULL OR fir IS NULL AS invalid FROM tested),
lim AS (SELECT {", ".join(f"min({x}) AS lo_{x}, max({x}) AS hi_{x}" for x in _GRAYS)} FROM f),
g AS (SELECT t, lat_i, lon_i, sea_coast, cold, invalid, {", ".join(f"coalesce(CAST(floor(255 * ({x} - lo_{x}) / nullif(hi_{x} - lo_{x}, 0)) AS INTEGER), 0) AS g_{x}" for x in _GRAYS)} FROM f, lim),
u AS ({" UNION ALL ".join(f"SELECT t, '{x}' AS kind, g_{x} AS x FROM g" for x in _GRAYS[:3])}), span AS (SELECT t, kind, min(x) AS lo, max(x) AS hi FROM u GROUP BY ALL),
h AS (SELECT t, kind, CAST(least(floor((x - lo) / ((hi - lo) / 256)), 255) AS INTEGER) AS bin, lo, hi, count(*) AS n FROM u JOIN span USING (t, kind) WHERE hi > lo GROUP BY ALL),
c AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256) AS c FROM h),
w AS (SELECT t, kind, bin, c, sum(n) OVER o AS w1, sum(n * c) OVER o AS s1, sum(n) OVER a AS w, sum(n * c) OVER a AS s FROM c WINDOW o AS (PARTITION BY t, kind ORDER BY bin), a AS (PARTITION BY t, kind)),
best AS (SELECT t, kind, c FROM w WHERE w > w1 QUALIFY row_number() OVER (PARTITION BY t, kind ORDER BY round(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / (w - w1), 2), 3) DESC, bin) = 1),
b AS (SELECT t, {", ".join(f"max(c) FILTER (kind = '{x}') AS l_{x}" for x in _GRAYS[:3])} FROM best GROUP BY t),
d AS (SELECT g.*, coalesce(g_ndsi > l_ndsi, false) AND coalesce(g_vis > l_vis, false) AS bright, coalesce(g_cli_eps > l_cli_eps, false) AND g_cli > 20 AS obvious FROM g LEFT JOIN b USING (t))
SELECT t, lat_i, lon_i, CASE WHEN obvious AND bright THEN 3 WHEN obvious THEN 1 WHEN cold THEN 8 WHEN bright AND g_falls > 30 THEN 7 WHEN bright AND g_rises > 30 THEN 6 WHEN bright THEN 5
  WHEN sea_coast THEN 12 WHEN invalid THEN 13 ELSE 0 END AS cls FROM d""")
def segmentation_tree(spark, sf_dir):
    return classify.segmentation_codes(_cube(spark, sf_dir))


@query(f"WITH {_INDEXED} SELECT t, lat_i, lon_i, coalesce(median(CASE WHEN slot = 2 AND NOT cloud_e THEN mir END) OVER (PARTITION BY lat_i, lon_i, dfb) > 280, false) AS warm FROM decided")
def warm_slots(spark, sf_dir):
    cube = classify.with_tests(classify.with_indexes(_cube(spark, sf_dir)))
    return classify.warm_ground(cube, "is_cloud", 280.0).select(*KEY, "warm")


@query("""
WITH d AS (SELECT lat_i, lon_i, t, cosz, dfb // 5 AS span, mir - lir AS x FROM cube),
p AS (SELECT a.lat_i, a.lon_i, a.span, b.t - a.t AS lag, b.x, a.cosz AS c FROM d a JOIN d b ON a.lat_i = b.lat_i AND a.lon_i = b.lon_i AND a.span = b.span AND b.t - a.t BETWEEN 1 AND 3 WHERE b.x IS NOT NULL),
f AS (SELECT lat_i, lon_i, span, lag, round(covar_pop(x, c) / (stddev_pop(x) * stddev_pop(c)), 9) AS r FROM p GROUP BY ALL HAVING count(*) > 2 AND stddev_pop(x) > 1e-9 AND stddev_pop(c) > 1e-9),
b AS (SELECT lag FROM f QUALIFY row_number() OVER (PARTITION BY lat_i, lon_i, span ORDER BY r DESC, lag) = 1 AND r > 0.3)
SELECT CAST(lag AS INTEGER) AS lag, count(*) AS n FROM b GROUP BY lag""")
def peak_lags(spark, sf_dir):
    return stats.peak_lags(_cube(spark, sf_dir).withColumn("x", F.col("mir") - F.col("lir")), "x", "cosz", 3, days=5, least=0.3)


@query("""
WITH RECURSIVE s AS (SELECT t, lat_i AS i, lon_i AS j, lir FROM cube WHERE vis > 0.5),
reach AS (SELECT t, i, j, i AS y, j AS x FROM s UNION SELECT r.t, r.i, r.j, s.i, s.j FROM reach r JOIN s ON s.t = r.t AND abs(s.i - r.y) <= 1 AND abs(s.j - r.x) <= 1),
m AS (SELECT r.t, r.i, r.j, coalesce(avg(s.lir), 0.0) AS m FROM reach r JOIN s ON s.t = r.t AND s.i = r.y AND s.j = r.x GROUP BY ALL)
SELECT c.t, c.lat_i, c.lon_i, round(greatest(max(m.m), 0.0), 6) AS mean
FROM cube c JOIN cube n ON n.t = c.t AND abs(n.lat_i - c.lat_i) <= 1 AND abs(n.lon_i - c.lon_i) <= 1 LEFT JOIN m ON m.t = n.t AND m.i = n.lat_i AND m.j = n.lon_i GROUP BY ALL""")
def region_mean(spark, sf_dir):
    out = grids.region_mean(_cube(spark, sf_dir).withColumn("seed", F.coalesce(F.col("vis") > 0.5, F.lit(False))), "seed", "lir", "mean")
    return out.select(*KEY, F.round("mean", 6).alias("mean"))


@query("""
WITH g AS (SELECT t, lat_i AS i, lon_i AS j, CAST(least(floor(vis * 200), 255) AS INTEGER) AS x FROM cube WHERE vis IS NOT NULL),
b AS (SELECT c.t, c.lat_i AS i, c.lon_i AS j, g.x, count(*) AS n FROM cube c JOIN g ON g.t = c.t AND (g.i - c.lat_i) * (g.i - c.lat_i) + (g.j - c.lon_i) * (g.j - c.lon_i) <= 4 GROUP BY ALL),
w AS (SELECT t, i, j, x, sum(n) OVER o AS w1, sum(n * x) OVER o AS s1, sum(n) OVER a AS w, sum(n * x) OVER a AS s FROM b WINDOW o AS (PARTITION BY t, i, j ORDER BY x), a AS (PARTITION BY t, i, j)),
l AS (SELECT t, i, j, x AS threshold FROM w WHERE w > w1 QUALIFY row_number() OVER (PARTITION BY t, i, j ORDER BY round(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / (w - w1), 2), 3) DESC, x) = 1)
SELECT c.t, c.lat_i, c.lon_i, coalesce(g.x > l.threshold, false) AS above FROM cube c LEFT JOIN g ON g.t = c.t AND g.i = c.lat_i AND g.j = c.lon_i LEFT JOIN l ON l.t = c.t AND l.i = c.lat_i AND l.j = c.lon_i""")
def local_otsu(spark, sf_dir):
    gray = _cube(spark, sf_dir).withColumn("gray", F.when(F.col("vis").isNotNull(), F.least(F.floor(F.col("vis") * 200), F.lit(255))).cast("int"))
    return grids.local_otsu(gray, "gray", 2)


@query()
def watershed(spark, sf_dir):
    """Held against plain versions in the tests."""
    return grids.watershed(_cube(spark, sf_dir), "lir", p=source.profile(spark, sf_dir))


@query()
def grow_seeds(spark, sf_dir):
    """Held against plain versions in the tests."""
    cube = classify.with_tests(classify.with_indexes(_cube(spark, sf_dir))).withColumn("allowed", F.col("zen") < math.radians(85))
    return grids.grow(cube, "is_cloud", "vis", "lir", "allowed", p=source.profile(spark, sf_dir))
