"""More of the query catalogue: sun and satellite, angular gates, tests by surface, layered tests, codes with shades."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import physics as P
from ..operators import classify, models, stats, timeseries
from ..sources import cube as source
from . import catalog_grids  # noqa: F401  (its SQL is used here)
from .catalog import _DAY, _INDEXED, _PX, KEY, ORACLE, PROFILE, _cube, _test, query, r
from .catalog_more import _TEXTURE, _near_days


#: the satellite's longitude in degrees: so far west of the grid that a part of it is beyond the satellite gate
_OVER = -56.0


def _with_angles(spark, sf_dir):
    """The cube with the sun's and a satellite's angles."""
    p = source.profile(spark, sf_dir)
    cube = source.load_cube(spark, sf_dir, p)
    cube = cube.withColumns({
        "lat": F.radians(p.lat0 + p.lat_step * F.col("lat_i")), "lon": F.radians(p.lon0 + p.lat_step * F.col("lon_i")),
        "dec": G.declination((F.col("dfb") - p.first_day) % 365 + 1), "hour": F.radians(15.0 * (F.col("slot") * p.hours_per_slot + p.hours_per_slot / 2 - 12)),
    })
    lat, lon, dec, hour, over = (*(F.col(c) for c in ("lat", "lon", "dec", "hour")), math.radians(_OVER))
    cube = cube.withColumns({"altitude": G.sun_altitude(lat, dec, hour), "sat_elevation": G.satellite_elevation(lat, lon, over), "sat_azimuth": G.satellite_azimuth(lat, lon, over)})
    cube = cube.withColumn("azimuth", G.sun_azimuth(lat, dec, hour, F.col("altitude"))).withColumn("sat_zen", math.pi / 2 - F.col("sat_elevation"))
    both = [F.col(c) for c in ("azimuth", "altitude", "sat_azimuth", "sat_elevation")]
    cube = cube.withColumns({"apart": G.between(*both), "mirror": G.between(*both, mirrored=True)})
    return cube.withColumn("glint", G.glint_angle(math.pi / 2 - F.col("altitude"), F.col("sat_zen"), F.col("apart")))


def _clip(x: str) -> str:
    return f"acos(greatest(-1.0, least(1.0, {x})))"


_ALONG = "cos(altitude) * cos(sat_elevation) * cos(azimuth - sat_azimuth)"
_UP = "sin(altitude) * sin(sat_elevation)"
_ANGLES = f"""placed AS (
  SELECT cube.*, radians(10.0::DOUBLE + 10.0::DOUBLE / side * lat_i) AS lat, radians(10.0::DOUBLE / side * lon_i - ({_OVER})) AS lon,  -- longitudes from the satellite's on
   
    radians(((dfb - 16071) % 365 + 1) / 365.0::DOUBLE * 360) AS j, radians(15.0::DOUBLE * (slot * 6 + 3 - 12)) AS hour FROM cube, grid
), declined AS (
  SELECT *, asin(0.3978::DOUBLE * sin(j - radians(80.2::DOUBLE) + radians(1.92::DOUBLE) * sin(j - radians(2.8::DOUBLE)))) AS dec, cos(lat) * cos(lon) AS seen FROM placed
), high AS (
  SELECT *, asin(sin(lat) * sin(dec) + cos(lat) * cos(dec) * cos(hour)) AS altitude, atan2(sin(lon), sin(lat) * cos(lon)) AS sat_azimuth,
    atan2(seen - 6378.137::DOUBLE / 42164, sqrt(greatest(0.0, 1 - seen * seen))) AS sat_elevation FROM declined
), turned AS (
  SELECT *, pi() / 2 - sat_elevation AS sat_zen,
    CASE WHEN sin(hour) < 0 THEN -1 ELSE 1 END * {_clip("(sin(lat) * sin(altitude) - sin(dec)) / nullif(cos(lat) * cos(altitude), 0)")} AS azimuth FROM high
), apart AS (
  SELECT *, {_clip(f"{_UP} + {_ALONG}")} AS apart, {_clip(f"{_UP} - {_ALONG}")} AS mirror FROM turned
), angled AS (
  SELECT *, {_clip("2 * sin(altitude) * cos(sat_zen) - cos(apart)")} AS glint FROM apart
)"""
_SHOWN = ("dec", "altitude", "azimuth", "sat_elevation", "sat_azimuth", "apart", "mirror", "glint")


@query(f"WITH {_ANGLES} SELECT t, lat_i, lon_i, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _SHOWN)} FROM angled")
def sun_satellite_angles(spark, sf_dir):
    return _with_angles(spark, sf_dir).select(*KEY, *(r(c).alias(c) for c in _SHOWN))


def _deg(x: str, limit: float, sign: str = ">") -> str:
    return f"{x} {sign} {math.radians(limit)!r}::DOUBLE"


@query(f"""
WITH {_ANGLES}, g AS (
  SELECT t, lat_i, lon_i, zen, {_deg("mirror", 15)} AND {_deg("mirror", 70, "<")} AS mirror_gate,
    {_deg("glint", 25)} OR ({_deg("glint", 40)} AND NOT is_land AND {_deg("mirror", 50)}) AS glint_gate,
    {_deg("sat_zen", 70, "<")} AND ({_deg("mirror", 25, "<")} OR {_deg("mirror", 50)}) AS satellite_gate FROM angled
)
SELECT t, lat_i, lon_i, mirror_gate, glint_gate, satellite_gate,
  mirror_gate AND glint_gate AND satellite_gate AND {_deg("zen", 75)} AND {_deg("zen", 89, "<")} AS seeds FROM g""")
def seed_gates(spark, sf_dir):
    land, zen, mirror, sat_zen, glint = (F.col(c) for c in ("is_land", "zen", "mirror", "sat_zen", "glint"))
    return _with_angles(spark, sf_dir).select(
        *KEY, G.mirror_gate(mirror).alias("mirror_gate"), G.glint_gate(land, mirror, glint).alias("glint_gate"),
        G.satellite_gate(mirror, sat_zen).alias("satellite_gate"), G.seed_gates(land, zen, mirror, sat_zen, glint).alias("seeds"),
    )


@query(f"""
WITH p AS (SELECT *, lag(lir) OVER ({_PX}) AS lir_0, lag(fir) OVER ({_PX}) AS fir_0 FROM cube)
SELECT t, lat_i, lon_i, {_test("abs(lir - lir_0) < CASE WHEN is_land THEN 5 ELSE 3 END")} OR {_test("abs((lir - fir) - (lir_0 - fir_0)) < 10")} AS stable FROM p""")
def thermal_stability(spark, sf_dir):
    lir, fir, past = F.col("lir"), F.col("fir"), timeseries.by_time()
    stable = P.thermal_stable(F.col("is_land"), lir, fir, F.lag("lir").over(past), F.lag("fir").over(past))
    return _cube(spark, sf_dir).select(*KEY, stable.alias("stable"))


@query(f"""
WITH m AS (SELECT *, CASE WHEN NOT {_test("lir < 260")} THEN vis END AS x FROM cube)
SELECT t, lat_i, lon_i, round(greatest(0.0, {", ".join(f"x - lag(x, {k}) OVER ({_DAY})" for k in (1, 2))}), 6) + 0.0 AS past,
  round(greatest(0.0, {", ".join(f"x - {f}(x, {k}) OVER ({_DAY})" for f in ("lag", "lead") for k in (1, 2))}), 6) + 0.0 AS near FROM m""")
def past_variability(spark, sf_dir):
    """Rises of the reflectance outside obvious cold clouds, against the days before and against all near days."""
    skip = P.test(F.col("lir") < 260)
    each = {"past": timeseries.positive_variability(F.col("vis"), only_past=True, skip=skip), "near": timeseries.positive_variability(F.col("vis"), skip=skip)}
    return _cube(spark, sf_dir).select(*KEY, *(r(c).alias(name) for name, c in each.items()))


_LAYERED = f"""WITH {_INDEXED}, {_TEXTURE}, x AS (SELECT d.*, texture FROM decided d JOIN sd USING (t, lat_i, lon_i)),
y AS (SELECT *, {_near_days("texture")} AS climbs FROM x),
z AS (SELECT *, (texture > 2 AND climbs > 0.2) OR (texture > 2 AND opaque) OR (opaque AND {_test("vis > 0.5")}) AS thick FROM y)"""


def _layered(spark, sf_dir):
    return classify.thick_cloud(classify.with_tests(classify.with_indexes(_cube(spark, sf_dir))))


@query(f"{_LAYERED} SELECT t, lat_i, lon_i, CASE WHEN cirrus THEN 4 WHEN transparent THEN 3 WHEN gross THEN 2 WHEN thick THEN 1 ELSE 0 END AS layer FROM z")
def layered_tests(spark, sf_dir):
    """1 thick, 2 gross, 3 transparent, 4 cirrus: the last test that holds."""
    return _layered(spark, sf_dir).select(*KEY, P.layers(F.col("thick"), F.col("gross"), F.col("transparent"), F.col("cirrus")).alias("layer"))


_SCORED = ("gross", "transparent", "thick")


def _shares(alone: bool) -> str:
    cond = lambda x: " AND ".join([x, *(f"NOT {y}" for y in _SCORED if y != x and alone)])
    return ", ".join(f"round(count(*) FILTER ({cond(x)}) / nullif(count(*) FILTER ({' OR '.join(_SCORED)}), 0), 6) AS {x}" for x in _SCORED)


@query(f"{_LAYERED} SELECT 'common' AS kind, {_shares(False)} FROM z WHERE is_land AND dawn_day UNION ALL SELECT 'unique', {_shares(True)} FROM z WHERE is_land AND dawn_day")
def regular_test_scores(spark, sf_dir):
    """Over land by day and dawn, of what the tests find together: each one's share, and what only it finds."""
    tests = _layered(spark, sf_dir).filter(F.col("is_land") & F.col("dawn_day")).select(*_SCORED)
    both = stats.common_scores(tests, list(_SCORED)).withColumn("kind", F.lit("common")).unionByName(stats.unique_scores(tests, list(_SCORED)).withColumn("kind", F.lit("unique")))
    return both.select("kind", *(F.round(c, 6).alias(c) for c in _SCORED))


@query(f"""
WITH {_INDEXED}, o AS (SELECT *, CASE WHEN opaque THEN cli_mu / 10 END AS thickness FROM decided),
v AS (SELECT *, {_near_days("thickness")} AS climbs FROM o)
SELECT t, lat_i, lon_i, opaque AND {_test("climbs > 1.5")} AS broken FROM v""")
def broken_cloud(spark, sf_dir):
    """Thickness in units of the opaque limit."""
    cube = classify.with_indexes(_cube(spark, sf_dir))
    opaque = P.opaque_cloud(F.col("cli_mu"), F.col("cli_eps"))
    return classify.broken_cloud(cube.withColumn("thickness", F.when(opaque, F.col("cli_mu") / 10))).select(*KEY, "broken")


@query("""
SELECT t, lat_i, lon_i, mir IS NOT NULL AND lir IS NOT NULL AND vis IS NOT NULL AS several, coalesce(mir BETWEEN 0 AND 300, false) AS single FROM cube""")
def trainable_rows(spark, sf_dir):
    several = P.trainable([F.col(c) for c in ("mir", "lir", "vis")])
    return _cube(spark, sf_dir).select(*KEY, several.alias("several"), P.trainable([F.col("mir")], single=True).alias("single"))


@query(f"""
WITH s AS (SELECT t, lat_i, lon_i, {", ".join(f"round_even(2 * ({c} - 200), 0) AS {c}" for c in ("fir", "lir", "mir"))} FROM cube)
SELECT t, lat_i, lon_i, {", ".join(f"CASE WHEN lir <= 0 OR lir > 250 THEN 0.0 WHEN lir IS NOT NULL THEN 255 * {c} END AS {n}" for c, n in zip(("fir", "lir", "mir"), ("red", "green", "blue"), strict=True))} FROM s""")
def low_cloud_composite(spark, sf_dir):
    colours = P.low_cloud_composite(F.col("fir"), F.col("lir"), F.col("mir"))
    return _cube(spark, sf_dir).select(*KEY, *(c.alias(name) for c, name in zip(colours, ("red", "green", "blue"), strict=True)))


@query(f"""
WITH {_INDEXED}
SELECT CAST(floor(round(ndsi, 9) * 100) AS INTEGER) AS bin, count(*) AS n
FROM tested JOIN (SELECT t, lat_i, lon_i, cls FROM classes) USING (t, lat_i, lon_i)
WHERE cls IN (0, 1) AND dawn_day AND is_land AND vis IS NOT NULL AND sir IS NOT NULL GROUP BY 1""")
def cloud_free_histogram(spark, sf_dir):
    """Of the snow index by day and dawn, where the static classes are cloud-free."""
    cube = _cube(spark, sf_dir)
    free = classify.classify(cube).filter(classify.reduce_two_classes(F.col("cls")) == 0).select(*KEY)
    index = classify.features(cube, "visible", "abstract", PROFILE).select(*KEY, F.round("ndsi", 9).alias("ndsi"))
    return models.index_histogram(index.join(free, KEY), "ndsi", 100)


@query()
def static_classifier_broad(spark, sf_dir):
    """The static classes with the broad snow test (a watershed through space and time) before the late one; held against a plain version in the tests."""
    return classify.classify_broad(_cube(spark, sf_dir))


@query(f"""
WITH codes AS ({ORACLE["segmentation_tree"]}),
u AS (
  SELECT t, lat_i, lon_i, cls, vis, cosz, median(CASE WHEN cls IN (0, 5) THEN vis END) OVER (PARTITION BY lat_i, lon_i, slot) AS usual
  FROM cube JOIN codes USING (t, lat_i, lon_i)
)
SELECT t, lat_i, lon_i, CASE WHEN cls IN (0, 5) AND {_test("usual - vis > 0.2 * cosz")} THEN 11 ELSE cls END AS cls FROM u""")
def segmentation_tree_shaded(spark, sf_dir):
    return classify.segmentation_codes(_cube(spark, sf_dir), shades=True)


@query()
def point_codes(spark, sf_dir):
    """The codes of the point tree with shades; held against a plain version in the tests."""
    p = source.profile(spark, sf_dir)
    return classify.point_codes(source.load_cube(spark, sf_dir, p), PROFILE)
