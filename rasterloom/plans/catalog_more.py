"""More of the query catalogue: masks, variants, patterns, gates, segmentation, patches, models and navigation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..config import CHANNELS
from ..functions import physics as P
from ..operators import classify, models, navigation, neighbourhood, patterns, segment, stats, timeseries
from ..sources import cube as source
from .catalog import _BOX, _DAY, _INDEXED, _LL, _PX, _SLICED, _K, KEY, PROFILE, _bt, _classes, _cube, _otsu, _points, _test, query, r

_PAST, _NEXT = f"OVER ({_PX} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", f"OVER ({_PX} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


def _near_days(x: str, sign: str = "{x} - {y}") -> str:
    """Largest rise over the same slot one or two days away."""
    each = (f"{f}({x}, {k}) OVER ({_DAY})" for f in ("lag", "lead") for k in (1, 2))
    return f"greatest(0.0, {', '.join(sign.format(x=x, y=y) for y in each)})"


# cleaning and entry features ---------------------------------------------------------------------------------

_ENDS = ", ".join(
    f"last_value({c} IGNORE NULLS) {_PAST} AS {c}0, last_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) {_PAST} AS {c}t0, "
    f"first_value({c} IGNORE NULLS) {_NEXT} AS {c}1, first_value(CASE WHEN {c} IS NOT NULL THEN t END IGNORE NULLS) {_NEXT} AS {c}t1"
    for c in CHANNELS
)
_FILLS = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}t1 - {c}t0 - 1 <= 3 THEN (({c}t1 - t) * {c}0 + (t - {c}t0) * {c}1) / ({c}t1 - {c}t0) END AS {c}" for c in CHANNELS)


@query(f"""WITH e AS (SELECT *, {_ENDS} FROM cube), f AS (SELECT t, lat_i, lon_i, {_FILLS} FROM e)
SELECT t, lat_i, lon_i, {", ".join(f"round(CASE WHEN {' OR '.join(f'{x} IS NULL' for x in CHANNELS)} THEN -1.0 ELSE {c} END, 9) AS {c}" for c in CHANNELS)} FROM f""")
def mask_channels(spark, sf_dir):
    return timeseries.mask_channels(_cube(spark, sf_dir)).select(*KEY, *(F.round(c, 9).alias(c) for c in CHANNELS))


@query(f"""WITH {_INDEXED} SELECT t, lat_i, lon_i, round(cli_eps, 6) + 0.0 AS cli_eps, round({_near_days("cli")}, 6) + 0.0 AS cli_variability, round(cli, 6) + 0.0 AS difference,
  CASE WHEN zen > 0 AND zen < {math.radians(85)!r} AND {_test(f"{_bt(12.4e-6, 0.85)} - lir > 8")} THEN 1 ELSE 0 END AS cold FROM ix""")
def infrared_features(spark, sf_dir):
    out = classify.features(_cube(spark, sf_dir), "infrared", "abstract")
    return out.select(*KEY, r("cli_eps").alias("cli_eps"), r("cli_variability").alias("cli_variability"), r("difference").alias("difference"), "cold")


@query(f"SELECT {', '.join(f'bool_and({c} BETWEEN 0 AND 350) AS {c}' for c in CHANNELS)} FROM cube")
def range_check(spark, sf_dir):
    return source.in_range(_cube(spark, sf_dir), list(CHANNELS), 0, 350)


@query(f"SELECT t, CAST(dfb AS INTEGER) AS dfb, slot, CAST((SELECT side FROM grid) - 1 - lat_i AS INTEGER) AS lat_i, lon_i, {', '.join(f'coalesce({c}, -999.0) AS {c}' for c in CHANNELS)} FROM cube")
def export_layout(spark, sf_dir):
    return source.for_export(_cube(spark, sf_dir), source.profile(spark, sf_dir)).select("t", "dfb", "slot", "lat_i", "lon_i", *CHANNELS)


@query(f"WITH p AS ({_LL}), k AS (SELECT id, CAST(floor((lat - 10) / (10.0::DOUBLE / side) + 0.5) AS INTEGER) AS i, CAST(floor(((lon % 360 + 360) % 360) / (10.0::DOUBLE / side) + 0.5) AS INTEGER) AS j, side FROM p, grid) SELECT id, CASE WHEN i >= 0 AND i < side THEN i END AS lat_i, CASE WHEN j >= 0 AND j < side THEN j END AS lon_i FROM k")
def nearest_cell(spark, sf_dir):
    i, j = source.nearest(F.col("lat"), F.col("lon"), source.profile(spark, sf_dir))
    return _points(spark, sf_dir).select("id", i.alias("lat_i"), j.alias("lon_i"))


# index and variability variants --------------------------------------------------------------------------------


@query("""
WITH d AS (SELECT t, lat_i, lon_i, cosz, mir - lir AS d FROM cube), s AS (SELECT avg(d) AS m, stddev_pop(d) AS sd, avg(cosz) AS cm, stddev_pop(cosz) AS csd FROM d),
z AS (SELECT t, lat_i, lon_i, cosz, (d - m) / nullif(sd, 0) AS z, (cosz - cm) / nullif(csd, 0) AS zc FROM d, s),
b AS (SELECT lat_i, lon_i, covar_pop(z, cosz) AS c, var_pop(cosz) AS v FROM z WHERE z IS NOT NULL GROUP BY ALL),
f AS (SELECT t, lat_i, lon_i, z - zc AS clear_sky, z - CASE WHEN v > 0 THEN c / nullif(v, 0) ELSE 0.0 END * cosz AS x FROM z LEFT JOIN b USING (lat_i, lon_i)),
w AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM f)
SELECT t, lat_i, lon_i, round(clear_sky, 5) + 0.0 AS clear_sky, round((x - m) / nullif(sd, 0), 5) + 0.0 AS without_bias FROM f, w""")
def cloud_index_variants(spark, sf_dir):
    cube = _cube(spark, sf_dir).withColumn("d", F.col("mir") - F.col("lir"))
    cube = stats.normalize(stats.normalize(cube, "d", "standard", "z"), "cosz", "standard", "zc")
    cube = cube.withColumn("x", timeseries.detrended(F.col("z"), F.col("cosz"))).withColumn("clear_sky", F.col("z") - F.col("zc"))
    return stats.normalize(cube, "x", "standard", "w").select(*KEY, r("clear_sky", 5).alias("clear_sky"), r("w", 5).alias("without_bias"))


@query(f"""
WITH b AS (SELECT lat_i, lon_i, covar_pop(lir, cosz) AS c, var_pop(cosz) AS v FROM cube WHERE lir IS NOT NULL GROUP BY ALL),
x AS (SELECT t, lat_i, lon_i, lir - CASE WHEN v > 0 THEN c / nullif(v, 0) ELSE 0.0 END * cosz AS x FROM cube LEFT JOIN b USING (lat_i, lon_i)),
d AS (SELECT t, lat_i, lon_i, x - lag(x) OVER ({_PX}) AS d FROM x)
SELECT t, lat_i, lon_i, round(coalesce(d / nullif((SELECT max(abs(d)) FROM d), 0), -10.0), 5) + 0.0 AS change FROM d""")
def variability_without_bias(spark, sf_dir):
    cube = _cube(spark, sf_dir).withColumn("x", timeseries.detrended(F.col("lir"), F.col("cosz")))
    step = timeseries.step_variability(F.col("x"))
    cube = stats.normalize(cube.withColumn("d", F.when(step != timeseries.FILL, step)), "d", "max", "n")
    return cube.select(*KEY, r(F.coalesce("n", F.lit(timeseries.FILL)), 5).alias("change"))


@query(f"SELECT t, lat_i, lon_i, round(avg(lir) OVER ({_PX} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS smooth FROM cube")
def centred_mean_time(spark, sf_dir):
    return _cube(spark, sf_dir).select(*KEY, F.round(timeseries.centred_mean(F.col("lir")), 6).alias("smooth"))


@query("""
WITH c AS (SELECT lat_i, lon_i, avg(mir - lir) AS a, avg(vis) AS b FROM cube GROUP BY ALL), s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM c)
SELECT lat_i, lon_i, round((a - ma) / nullif(sa, 0) - (b - mb) / nullif(sb, 0), 5) + 0.0 AS difference FROM c, s""")
def map_difference(spark, sf_dir):
    maps = _cube(spark, sf_dir).groupBy("lat_i", "lon_i").agg(F.avg(F.col("mir") - F.col("lir")).alias("a"), F.avg("vis").alias("b"))
    maps = stats.normalize(stats.normalize(maps, "a", "standard", "za"), "b", "standard", "zb")
    return maps.select("lat_i", "lon_i", r(F.col("za") - F.col("zb"), 5).alias("difference"))


@query(f"SELECT t, lat_i, lon_i, round(exp(-(vis - 0.25)), 6) AS smooth, round(1 / greatest(pow(greatest(cos(zen), 0.0), 0.3), 0.04), 6) AS factor, round(2 * cos(zen) * cos(0.5) - cos(0.7), 6) + 0.0 AS glint, round((exp(-2.0 * abs(vis - 0.6)) - {math.exp(-1.2)!r}) / (1 - {math.exp(-1.2)!r}), 6) + 0.0 AS tricky FROM cube")
def smooth_functions(spark, sf_dir):
    zen, vis = F.col("zen"), F.col("vis")
    return _cube(spark, sf_dir).select(
        *KEY, F.round(P.smooth_threshold(vis, 0.25), 6).alias("smooth"), F.round(P.angular_factor(zen), 6).alias("factor"),
        r(P.glint_angle_cosine(zen, F.lit(0.5), F.lit(0.7))).alias("glint"), r(P.tricky_index(vis, 2.0, 0.6)).alias("tricky"),
    )


# patterns ------------------------------------------------------------------------------------------------------

_CORR = """SELECT lat_i, lon_i, slice, count(*) AS n, CASE WHEN stddev_pop(cosz) > 1e-9 AND stddev_pop({x}) > 1e-9 THEN covar_pop({x}, cosz) / (stddev_pop({x}) * stddev_pop(cosz)) END AS r
  FROM {f} WHERE {x} IS NOT NULL GROUP BY ALL HAVING count(*) > 12"""


@query(f"""WITH {_SLICED}, x AS (SELECT *, (vis - sir) / greatest(sir + vis, 0.02) AS ndsi FROM sliced), s AS ({_CORR.format(x="ndsi", f="x")})
SELECT lat_i, lon_i, slice, n, round(r, 5) + 0.0 AS r, CASE WHEN coalesce(r > 1 - 0.9, false) THEN 1 ELSE 0 END AS verdict FROM s""")
def pattern_ndsi(spark, sf_dir):
    sliced = patterns.with_slices(classify.with_indexes(_cube(spark, sf_dir)), 40, PROFILE.first_day)
    return patterns.correlation_verdicts(sliced, "ndsi", "cosz", 0.9).withColumn("r", r("r", 5))


_W = patterns.kernel(1.0, 2.0)


@query(f"""WITH {_SLICED}, x AS (SELECT *, (vis - sir) / greatest(sir + vis, 0.02) AS ndsi FROM sliced), s AS ({_CORR.format(x="ndsi", f="x")}),
v AS (SELECT lat_i, lon_i, slice, CASE WHEN coalesce(r > 1 - 0.9, false) THEN 1.0::DOUBLE ELSE 0.0 END AS v, row_number() OVER (PARTITION BY lat_i, lon_i ORDER BY slice) - 1 AS i, count(*) OVER (PARTITION BY lat_i, lon_i) AS k FROM s),
j AS (SELECT a.lat_i, a.lon_i, a.slice, a.v, w.w, w.d, (((a.i + w.d) % (2 * a.k)) + 2 * a.k) % (2 * a.k) AS m, a.k FROM v a, (VALUES {", ".join(f"({i - len(_W) // 2}, {x!r}::DOUBLE)" for i, x in enumerate(_W))}) w(d, w)),
p AS (SELECT j.lat_i, j.lon_i, j.slice, any_value(j.v) AS v, sum(j.w * b.v) AS p FROM j JOIN v b ON j.lat_i = b.lat_i AND j.lon_i = b.lon_i AND b.i = CASE WHEN m < j.k THEN m ELSE 2 * j.k - 1 - m END GROUP BY ALL)
SELECT lat_i, lon_i, slice, CAST(v AS INTEGER) AS verdict, round(coalesce(p / nullif((SELECT max(abs(p)) FROM p), 0), 0.0), 6) + 0.0 AS persistent FROM p""")
def pattern_persistence(spark, sf_dir):
    sliced = patterns.with_slices(classify.with_indexes(_cube(spark, sf_dir)), 40, PROFILE.first_day)
    out = patterns.persistence(patterns.correlation_verdicts(sliced, "ndsi", "cosz", 0.9), 1.0, 2.0)
    return out.select("lat_i", "lon_i", "slice", "verdict", r("persistent").alias("persistent"))


@query(f"""WITH {_SLICED}, s AS (SELECT lat_i, lon_i, slice, count(*) AS n, covar_pop(sir, cosz) AS c, var_pop(cosz) AS v FROM sliced WHERE sir IS NOT NULL GROUP BY ALL)
SELECT x.t, x.lat_i, x.lon_i, CASE WHEN n > 12 THEN CASE WHEN v > 1e-12 AND abs(c / nullif(v, 0)) <= 0.1 THEN 1 ELSE 0 END END AS flat FROM sliced x LEFT JOIN s USING (lat_i, lon_i, slice)""")
def flat_sir(spark, sf_dir):
    sliced = patterns.with_slices(_cube(spark, sf_dir), 40, PROFILE.first_day)
    return patterns.on_slots(sliced, patterns.flat(sliced, "sir", "cosz", 0.1), "verdict", "flat").select(*KEY, "flat")


# gates and single tests ----------------------------------------------------------------------------------------


def _deg(lo: float, hi: float) -> str:
    return f"(zen > {math.radians(lo)!r} AND zen < {math.radians(hi)!r})"


@query(f"""SELECT t, lat_i, lon_i, {_test(f"exp(-{_K!r}::DOUBLE * (1.0 / fir - 1.0 / lir)) < 0.2 AND lir < 303.15")} AS lir_fir,
  {_test("(vis - sir) / greatest(sir + vis, 0.02) > 0.3 + 0.15 * pow(cosz - 1, 2)")} AS ndsi_scatter, {_test("is_land AND vis - 0.2 > 0.1")} AS land_bright,
  {_test(f"{_deg(15, 85)} AND mir < 320 AND vis > 0.6 AND mir - lir > 0 AND vis > (mir - lir) / 0.15")} AS glint_cloud, {_test("NOT is_land AND vis > 0.2 + 0.1 * slot")} AS cloudy_sea,
  CASE WHEN fir IS NOT NULL THEN CASE WHEN fir < 240 THEN 1 ELSE 0 END END AS cold, {_deg(15, 70)} AND {_deg(25, 70)} AS seeds_angle, {_test("vis > 1.05 * 0.3")} AS seeds_vis, {_test("lir > 265 AND lir < 270.5")} AS seeds_lir FROM cube""")
def single_tests(spark, sf_dir):
    fir, lir, mir, sir, vis, land, zen = (F.col(c) for c in (*CHANNELS, "is_land", "zen"))
    return _cube(spark, sf_dir).select(
        *KEY, P.lir_fir(lir, fir).alias("lir_fir"), P.ndsi_test(P.snow_index(vis, sir), F.col("cosz")).alias("ndsi_scatter"), P.land_visible(land, vis, F.lit(0.2)).alias("land_bright"),
        P.sun_glint_low_cloud(F.col("cosz"), vis, mir, lir).alias("glint_cloud"), P.test(~land & (vis > 0.2 + 0.1 * F.col("slot"))).alias("cloudy_sea"),
        F.when(fir.isNotNull(), (fir < 240).cast("int")).alias("cold"), (P.gate(zen, "satellite") & P.between_degrees(zen, 25, 70)).alias("seeds_angle"),
        P.seeds_visible(vis, F.lit(0.3)).alias("seeds_vis"), P.seeds_infrared(lir, F.lit(270.0)).alias("seeds_lir"),
    )


@query(f"""WITH {_INDEXED}, s AS (SELECT *, {_test(f"abs(lir - lag(lir) OVER ({_PX})) < 5")} AS stable FROM decided)
SELECT t, lat_i, lon_i, stable, coalesce(lag(cloud_e, 3) OVER ({_PX}), false) AND coalesce(lag(cloud_e, 4) OVER ({_PX}), false) AND stable AS flagged, cloud_e AND NOT cirrus AS without_cirrus FROM s""")
def stability_tests(spark, sf_dir):
    cube = classify.with_tests(classify.with_indexes(_cube(spark, sf_dir)))
    stable = P.stable(F.col("lir"), F.lag("lir").over(timeseries.by_time()), 5.0)
    flagged = timeseries.followed(F.col("is_cloud"), (3, 4)) & stable
    return cube.select(*KEY, stable.alias("stable"), flagged.alias("flagged"), (F.col("is_cloud") & ~F.col("cirrus")).alias("without_cirrus"))


@query(f"SELECT t, lat_i, lon_i, round(greatest(255 * vis, 0.0), 6) AS red, round(greatest(255 * sir, 0.0), 6) AS green, round(greatest(255 * ((mir - 250) / 100), 0.0), 6) + 0.0 AS blue, {_test('vis = -1 AND sir = -1 AND mir = -1')} AS night_like FROM cube WHERE vis IS NOT NULL AND sir IS NOT NULL AND mir IS NOT NULL")
def snow_composite(spark, sf_dir):
    cube = _cube(spark, sf_dir).filter("vis is not null and sir is not null and mir is not null")
    red, green, blue = P.snow_composite(F.col("vis"), F.col("sir"), F.col("mir"))
    return cube.select(*KEY, F.round(red, 6).alias("red"), F.round(green, 6).alias("green"), r(blue).alias("blue"), P.night_like(F.col("vis"), F.col("sir"), F.col("mir")).alias("night_like"))


_TEXTURE = f"""box AS ({_BOX.replace("coalesce(vis, 0.0)", "coalesce(lir, 0.0)")}), sd AS (
  SELECT t, lat_i, lon_i, round(sqrt(greatest(avg(x * x) - pow(avg(x), 2), 0.0)), 4) AS texture FROM box GROUP BY ALL)"""


@query(f"""WITH {_INDEXED}, {_TEXTURE}, x AS (SELECT d.*, texture FROM decided d JOIN sd USING (t, lat_i, lon_i)),
y AS (SELECT *, {_near_days("texture")} AS rise FROM x)
SELECT t, lat_i, lon_i, texture, opaque AS quick, (texture > 2 AND rise > 0.2) OR (texture > 2 AND opaque) OR (opaque AND {_test("vis > 0.5")}) AS thick FROM y""")
def thick_cloud(spark, sf_dir):
    cube = classify.with_indexes(_cube(spark, sf_dir))
    both = classify.thick_cloud(classify.thick_cloud(cube, quick=True).withColumnRenamed("thick", "quick"))
    return both.select(*KEY, "texture", "quick", "thick")


@query(f"""WITH {_TEXTURE}, bad AS (SELECT t, lat_i, lon_i, lir IS NULL AS m FROM cube), cross_ AS (
  SELECT a.t, a.lat_i, a.lon_i, bool_or(b.m) AS m FROM bad a JOIN bad b ON a.t = b.t AND abs(a.lat_i - b.lat_i) + abs(a.lon_i - b.lon_i) <= 1 GROUP BY ALL)
SELECT t, lat_i, lon_i, CASE WHEN m THEN -10.0 ELSE texture END AS texture FROM sd JOIN cross_ USING (t, lat_i, lon_i)""")
def masked_texture(spark, sf_dir):
    cube = _cube(spark, sf_dir).withColumn("m", F.col("lir").isNull()).withColumn("x", F.coalesce("lir", F.lit(0.0)))
    cube = neighbourhood.masked(neighbourhood.local_std(cube, "x", "sd"), "m", "wide")
    return cube.select(*KEY, F.when(F.col("wide"), -10.0).otherwise(F.round("sd", 4)).alias("texture"))


# aggregates and sampling ---------------------------------------------------------------------------------------


@query(f"WITH {_INDEXED} SELECT round(count(*) FILTER (opaque) / nullif(count(*) FILTER (gross), 0), 6) AS ratio FROM decided")
def test_ratio(spark, sf_dir):
    cube = classify.with_tests(classify.with_indexes(_cube(spark, sf_dir)))
    return cube.agg(F.round(F.try_divide(F.count_if("opaque"), F.count_if("gross")), 6).alias("ratio"))


@query(f"WITH {_INDEXED} SELECT cls, count(*) AS n FROM classes GROUP BY cls")
def class_counts(spark, sf_dir):
    return _classes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("n"))


@query(f"WITH {_INDEXED}, d AS (SELECT lat_i, lon_i, dfb, median(CASE WHEN cls IN (0, 1) THEN mir END) AS m FROM classes JOIN (SELECT t, lat_i, lon_i, mir FROM cube) USING (t, lat_i, lon_i) WHERE slot BETWEEN 1 AND 2 GROUP BY ALL) SELECT lat_i, lon_i, dfb, {_test('m > 270')} AS warm FROM d")
def warm_ground(spark, sf_dir):
    """Days whose median cloud-free mir around noon is warm."""
    both = classify._with_class(_cube(spark, sf_dir), True).filter(F.col("slot").between(1, 2))
    return both.groupBy("lat_i", "lon_i", "dfb").agg(F.median(F.when(F.col("cls").isin(0, 1), F.col("mir"))).alias("m")).select("lat_i", "lon_i", "dfb", P.test(F.col("m") > 270).alias("warm"))


@query("""
WITH l AS (SELECT a.lat_i, a.lon_i, k.lag, b.mir - b.lir AS d, a.cosz FROM cube a, (VALUES (1), (2), (3)) k(lag) JOIN cube b ON a.lat_i = b.lat_i AND a.lon_i = b.lon_i AND b.t = a.t + k.lag WHERE b.mir - b.lir IS NOT NULL),
c AS (SELECT lat_i, lon_i, lag, round(covar_pop(d, cosz) / nullif(stddev_pop(d) * stddev_pop(cosz), 0), 6) AS r FROM l GROUP BY ALL)
SELECT lat_i, lon_i, arg_max(lag, (r, -lag)) AS lag, max(r) AS r FROM c WHERE r IS NOT NULL GROUP BY ALL""")
def lag_of_peak(spark, sf_dir):
    """The lag (1..3 slots) at which mir - lir follows the sun best."""
    cube = _cube(spark, sf_dir).withColumn("d", F.col("mir") - F.col("lir"))
    cube = cube.withColumns({f"d{k}": F.lead("d", k).over(timeseries.by_time()) for k in (1, 2, 3)})
    shifted = cube.select("lat_i", "lon_i", "cosz", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"d{k}").alias("d")) for k in (1, 2, 3)))).alias("s"))
    both = shifted.select("lat_i", "lon_i", "cosz", "s.lag", "s.d").filter("d is not null").groupBy("lat_i", "lon_i", "lag")
    c = both.agg(F.round(F.try_divide(F.covar_pop("d", "cosz"), F.stddev_pop("d") * F.stddev_pop("cosz")), 6).alias("r")).filter("r is not null")
    return c.groupBy("lat_i", "lon_i").agg(F.max(F.struct("r", (-F.col("lag")).alias("k"))).alias("b")).select("lat_i", "lon_i", (-F.col("b.k")).alias("lag"), F.col("b.r").alias("r"))


@query("WITH s AS (SELECT t FROM cube GROUP BY t HAVING (t * 7919) % 10007 % 10 < 3) SELECT t, lat_i, lon_i, vis, is_land FROM cube SEMI JOIN s USING (t)")
def restrict_pools(spark, sf_dir):
    picked = source.time_axis(source.read(spark, sf_dir, "events"), PROFILE).filter((F.col("t") * 7919) % 10007 % 10 < 3).select("t")
    return _cube(spark, sf_dir).join(picked, "t", "left_semi").select(*KEY, "vis", "is_land")


@query("SELECT t, lat_i, lon_i, vis FROM cube WHERE dfb < 16080 UNION ALL SELECT t, lat_i, lon_i, vis FROM cube WHERE dfb >= 16090")
def append_stacks(spark, sf_dir):
    cube = _cube(spark, sf_dir).select(*KEY, "vis", "dfb")
    return cube.filter("dfb < 16080").unionByName(cube.filter("dfb >= 16090")).drop("dfb")


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS predicted, round(CAST(list_max(embedding) AS DOUBLE), 6) + 0.0 AS confidence FROM embeddings")
def most_likely(spark, sf_dir):
    out = models.most_likely(source.read(spark, sf_dir, "embeddings"), "embedding")
    return out.select("vec_id", "predicted", r(F.col("confidence").cast("double")).alias("confidence"))


@query("SELECT CAST(floor(((vis - sir) / greatest(sir + vis, 0.02)) * 20) AS INTEGER) AS bin, count(*) AS n FROM cube WHERE (vis - sir) / greatest(sir + vis, 0.02) > -9 GROUP BY 1")
def snow_histogram(spark, sf_dir):
    return models.index_histogram(classify.with_indexes(_cube(spark, sf_dir)), "ndsi", 20)


# segmentation and patches --------------------------------------------------------------------------------------


@query(f"WITH o AS ({_otsu('t')}) SELECT t, lat_i, lon_i, {_test('lir > threshold')} AS above FROM cube LEFT JOIN o ON t = g")
def otsu_mask(spark, sf_dir):
    return segment.segmentation(_cube(spark, sf_dir), "lir", "otsu-2d").select(*KEY, "above")


@query(f"WITH o AS ({_otsu('1')}) SELECT t, lat_i, lon_i, {_test('lir > threshold')} AS above FROM cube, o")
def otsu_mask_global(spark, sf_dir):
    return segment.segmentation(_cube(spark, sf_dir), "lir", "otsu-3d").select(*KEY, "above")


def _line_blur(x: str, part: str) -> str:
    w = f"(PARTITION BY t, {part})".replace(")", f" ORDER BY {'lon_i' if part == 'lat_i' else 'lat_i'})")
    return f"(coalesce(lag({x}) OVER {w}, lead({x}) OVER {w}, {x}) + 2 * {x} + coalesce(lead({x}) OVER {w}, lag({x}) OVER {w}, {x})) / 4"


@query(f"WITH a AS (SELECT *, coalesce(vis, 0.0) AS x FROM cube), b AS (SELECT t, lat_i, lon_i, {_line_blur('x', 'lat_i')} AS y FROM a) SELECT t, lat_i, lon_i, round({_line_blur('y', 'lon_i')}, 11) AS blurred FROM b")
def blurred(spark, sf_dir):
    cube = _cube(spark, sf_dir).withColumn("x", F.coalesce("vis", F.lit(0.0)))
    return neighbourhood.blur(cube, "x", "blurred").select(*KEY, F.round("blurred", 11).alias("blurred"))


@query(f"SELECT c.t, c.lat_i, c.lon_i, {', '.join(f'coalesce(max(n.x) FILTER (n.lat_i = c.lat_i + {i // 3 - 1} AND n.lon_i = c.lon_i + {i % 3 - 1}), -1.0) AS p{i}' for i in range(9))} FROM cube c JOIN (SELECT t, lat_i, lon_i, coalesce(vis, 0.0) AS x FROM cube) n ON c.t = n.t AND abs(c.lat_i - n.lat_i) <= 1 AND abs(c.lon_i - n.lon_i) <= 1 GROUP BY ALL")
def sliding_patches(spark, sf_dir):
    cube = _cube(spark, sf_dir).withColumn("x", F.coalesce("vis", F.lit(0.0)))
    return neighbourhood.patch(cube, "x", "p").select(*KEY, *(f"p{i}" for i in range(9)))


@query("SELECT t, CAST(lat_i // 2 AS INTEGER) AS tile_lat, CAST(lon_i // 2 AS INTEGER) AS tile_lon, count(*) AS cells, round(avg(vis), 9) AS mean, bool_or(is_land AND lat_i % 2 = 1 AND lon_i % 2 = 1) AS centre_land FROM cube, grid WHERE lat_i < side - side % 2 AND lon_i < side - side % 2 GROUP BY ALL")
def tiles(spark, sf_dir):
    """Non-overlapping 2x2 tiles with the label of the cell past their centre; incomplete tiles are cropped."""
    even = source.profile(spark, sf_dir).n_lat // 2 * 2
    cube = _cube(spark, sf_dir).filter((F.col("lat_i") < even) & (F.col("lon_i") < even))
    centre = F.col("is_land") & (F.col("lat_i") % 2 == 1) & (F.col("lon_i") % 2 == 1)
    keyed = cube.groupBy("t", F.floor(F.col("lat_i") / 2).cast("int").alias("tile_lat"), F.floor(F.col("lon_i") / 2).cast("int").alias("tile_lon"))
    return keyed.agg(F.count("*").alias("cells"), F.round(F.avg("vis"), 9).alias("mean"), F.bool_or(centre).alias("centre_land"))


# models --------------------------------------------------------------------------------------------------------


@query("""
WITH q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id % 50 = 0), d AS (
  SELECT q.vec_id, q.label, e.label AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(q.x, CAST(e.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6), e.vec_id) AS k
  FROM q JOIN embeddings e ON e.vec_id <> q.vec_id
), v AS (SELECT vec_id, label, other, count(*) AS n FROM d WHERE k <= 7 GROUP BY ALL)
SELECT vec_id, label, arg_max(other, (n, -other)) AS predicted FROM v GROUP BY ALL""")
def knn_vote(spark, sf_dir):
    vectors = source.read(spark, sf_dir, "embeddings")
    return models.knn_vote(vectors, vectors.filter("vec_id % 50 = 0"))


_EVIDENCE = {"a": "embedding[1] > 0", "b": "embedding[2] > 0.05", "c": "embedding[3] > -0.05"}


@query(f"""
WITH e AS (SELECT vec_id, label % 3 AS cls, {", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS {k}" for k, c in _EVIDENCE.items())} FROM embeddings),
l AS (SELECT vec_id, cls, name, value FROM e UNPIVOT (value FOR name IN (a, b, c))), n AS (SELECT cls, count(*) AS n, count(*) / (SELECT count(*) FROM e) AS prior FROM e GROUP BY cls),
t AS (SELECT name, value, cls, (count(*) + 1) / (any_value(n) + any_value(v)) AS p FROM l JOIN n USING (cls) JOIN (SELECT name, count(DISTINCT value) AS v FROM l GROUP BY name) USING (name) GROUP BY ALL),
w AS (SELECT l.vec_id, t.cls, exp(sum(ln(p))) AS p FROM l JOIN t USING (name, value) GROUP BY ALL), x AS (SELECT vec_id, cls, p * prior AS w FROM w JOIN n USING (cls))
SELECT vec_id, cls, round(w / sum(w) OVER (PARTITION BY vec_id), 6) AS posterior FROM x""")
def naive_bayes_posterior(spark, sf_dir):
    """Posterior of three classes from three binary evidences, with tables estimated from the labels."""
    x = F.col("embedding")
    e = source.read(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 3).alias("cls"), *(c.cast("int").alias(k) for k, c in zip("abc", (x[0] > 0, x[1] > 0.05, x[2] > -0.05), strict=True)))
    priors, tables = models.likelihoods(e, ["a", "b", "c"], "cls")
    return models.bayes_posterior(e, "vec_id", ["a", "b", "c"], "cls", priors, tables).withColumn("posterior", F.round("posterior", 6))


@query()
def cloud_covertness(spark, sf_dir):
    return models.cloud_covertness(classify.with_indexes(_cube(spark, sf_dir)).select(*KEY, "cli")).select(*KEY, "grade")


@query()
def cloud_variability(spark, sf_dir):
    cube = classify.with_indexes(_cube(spark, sf_dir))
    return models.cloud_variability(cube.select(*KEY, timeseries.positive_variability(F.col("cli")).alias("v")), "v").select(*KEY, "grade")


@query()
def brightness_grade(spark, sf_dir):
    return models.brightness(_cube(spark, sf_dir).select(*KEY, "vis")).select(*KEY, "grade")


@query()
def brightness_variability(spark, sf_dir):
    cube = _cube(spark, sf_dir).select(*KEY, timeseries.positive_variability(F.col("vis")).alias("v"))
    return models.brightness_variability(cube, "v").select(*KEY, "grade")


# navigation and dates ------------------------------------------------------------------------------------------

_PLANE = f"""p AS ({_LL}), q AS (SELECT *, atan({(navigation.AXIS_B / navigation.AXIS_A) ** 2!r}::DOUBLE * tan(radians(lat))) AS phi, radians(lon - 5.0) AS lam FROM p),
s AS (SELECT *, {navigation.AXIS_B / navigation.AXIS_A!r}::DOUBLE / sqrt(pow({navigation.AXIS_B / navigation.AXIS_A!r}::DOUBLE * cos(phi), 2) + pow(sin(phi), 2)) AS r FROM q),
v AS (SELECT *, r * cos(lam) * cos(phi) AS vx, r * sin(lam) * cos(phi) AS vy, r * sin(phi) AS vz, {1 + navigation.HEIGHT / navigation.AXIS_A!r}::DOUBLE AS far FROM s),
g AS (SELECT id, (far - vx) * vx - vy * vy - vz * vz / {(navigation.AXIS_B / navigation.AXIS_A) ** 2!r}::DOUBLE >= 0 AS seen,
  {navigation.HEIGHT!r}::DOUBLE * atan(vz / sqrt(pow(far - vx, 2) + vy * vy)) AS y, {navigation.HEIGHT!r}::DOUBLE * atan(vy / (far - vx)) AS x FROM v)"""


@query(f"""WITH {_PLANE} SELECT id, CASE WHEN seen THEN round(y, 2) + 0.0 END AS y, CASE WHEN seen THEN round(x, 2) + 0.0 END AS x,
  CASE WHEN seen THEN CAST(floor((y - 5000000.0) / -3000.0 + 0.5) AS INTEGER) END AS l, CASE WHEN seen THEN CAST(floor((x + 5000000.0) / 3000.0 + 0.5) AS INTEGER) END AS c FROM g""")
def ll_to_plane(spark, sf_dir):
    y, x = navigation.ll_to_plane(F.col("lat"), F.col("lon"), 5.0)
    line, column = navigation.plane_to_index(F.col("py"), F.col("px"), 5e6, -5e6, -3000.0, 3000.0)
    return _points(spark, sf_dir).select("id", y.alias("py"), x.alias("px")).select("id", r("py", 2).alias("y"), r("px", 2).alias("x"), line.alias("l"), column.alias("c"))


@query(f"WITH {_PLANE} SELECT id, CASE WHEN seen THEN round(lat, 5) + 0.0 END AS lat, CASE WHEN seen THEN round(lon, 5) + 0.0 END AS lon FROM g JOIN p USING (id)")
def plane_round_trip(spark, sf_dir):
    """Projected and back: what the satellite sees returns to itself."""
    y, x = navigation.ll_to_plane(F.col("lat"), F.col("lon"), 5.0)
    seen = _points(spark, sf_dir).select("id", y.alias("py"), x.alias("px"))
    lat, lon = navigation.plane_to_ll(F.col("py"), F.col("px"), 5.0)
    return seen.select("id", r(lat, 5).alias("lat"), r(lon, 5).alias("lon"))


def _inverse(l: str, c: str) -> str:
    q = (navigation.REQ / navigation.RPOL) ** 2
    h = navigation.ORBIT
    return f"""n AS (SELECT l AS to_l, c AS to_c, -0.16 + {l} * 0.02 + 0.01 AS y, -0.16 + {c} * 0.02 + 0.01 AS x FROM raster),
b AS (SELECT *, pow(sin(x), 2) + pow(cos(x), 2) * (pow(cos(y), 2) + {q!r}::DOUBLE * pow(sin(y), 2)) AS qa, -2 * {h!r}::DOUBLE * cos(x) * cos(y) AS qb, {h**2 - navigation.REQ**2!r}::DOUBLE AS qc FROM n),
k AS (SELECT *, CASE WHEN qb * qb - 4 * qa * qc >= 0 THEN (-qb - sqrt(greatest(qb * qb - 4 * qa * qc, 0.0))) / (2 * qa) END AS rs FROM b),
m AS (SELECT *, rs * cos(x) * cos(y) AS sx, -rs * sin(x) AS sy, rs * cos(x) * sin(y) AS sz FROM k),
p AS (SELECT to_l, to_c, degrees(atan({q!r}::DOUBLE * sz / sqrt(pow({h!r}::DOUBLE - sx, 2) + sy * sy))) AS lat, 7.0 - degrees(atan(sy / ({h!r}::DOUBLE - sx))) AS lon FROM m),
f AS (SELECT *, atan({(navigation.RPOL / navigation.REQ) ** 2!r}::DOUBLE * tan(radians(lat))) AS pc, radians(lon - 5.0) AS lam FROM p),
g AS (SELECT *, {navigation.RPOL} / sqrt(1 - {navigation.E2!r}::DOUBLE * pow(cos(pc), 2)) AS rc FROM f),
s AS (SELECT *, {h!r}::DOUBLE - rc * cos(pc) * cos(lam) AS sx, -rc * cos(pc) * sin(lam) AS sy, rc * sin(pc) AS sz FROM g),
i AS (SELECT to_l, to_c, CAST(floor((atan(sz / sx) + 0.16) / 0.02) AS INTEGER) AS l, CAST(floor((asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)) + 0.16) / 0.02) AS INTEGER) AS c FROM s)"""


@query(f"WITH raster AS (SELECT CAST(c_custkey % 256 // 16 AS INTEGER) AS l, CAST(c_custkey % 16 AS INTEGER) AS c, round(max(c_acctbal), 2) AS v FROM customer GROUP BY ALL), {_inverse('l', 'c')} SELECT i.to_l AS l, i.to_c AS c, v FROM i LEFT JOIN raster USING (l, c)")
def renavigate(spark, sf_dir):
    i = F.col("c_custkey")
    raster = source.read(spark, sf_dir, "customer").groupBy(F.floor(i % 256 / 16).cast("int").alias("l"), (i % 16).cast("int").alias("c")).agg(F.round(F.max("c_acctbal"), 2).alias("v"))
    return navigation.renavigate(raster, 5.0, 7.0, 0.02, -0.16).select("l", "c", "v")


@query("""SELECT DISTINCT dfb, strftime(DATE '1980-01-01' + CAST(dfb AS INTEGER), '%Y%m%d') AS day, CAST(dayofyear(DATE '1980-01-01' + CAST(dfb AS INTEGER)) AS INTEGER) AS doy,
  CAST(DATE '1980-01-01' + CAST(dfb AS INTEGER) AS VARCHAR) AS start, CAST(DATE '1980-01-01' + CAST(dfb + 1 AS INTEGER) AS VARCHAR) AS stop, 1440 // (360 * 1) AS slots FROM cube""")
def day_names(spark, sf_dir):
    day = F.date_add(F.lit("1980-01-01").cast("date"), F.col("dfb"))
    axis = source.time_axis(source.read(spark, sf_dir, "events"), PROFILE).select("dfb").distinct()
    return axis.select("dfb", F.date_format(day, "yyyyMMdd").alias("day"), F.dayofyear(day).alias("doy"), day.cast("string").alias("start"), F.date_add(day, 1).cast("string").alias("stop"), F.lit(PROFILE.slots_per_day).alias("slots"))
