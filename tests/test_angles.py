"""Sun and satellite, tests by surface, and the codes of both trees with broad snow and shades, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterloom.functions import geometry as G
from rasterloom.functions import physics as P
from rasterloom.operators import classify, neighbourhood, tiles
from rasterloom.sources import cube as source

from .conftest import SF

KEY = ["t", "lat_i", "lon_i"]


def _direction(azimuth, elevation):
    """East, north and up of a direction whose azimuth counts from the south towards the west."""
    return np.array([-math.sin(azimuth) * math.cos(elevation), -math.cos(azimuth) * math.cos(elevation), math.sin(elevation)])


def test_directions_by_vectors(spark):
    rng = np.random.default_rng(4)
    places = [(float(a), float(o), float(d), float(h)) for a, o, d, h in zip(rng.uniform(-1.3, 1.3, 60), rng.uniform(-1, 1, 60), rng.uniform(-0.4, 0.4, 60), rng.uniform(-3, 3, 60), strict=True)]
    df = spark.createDataFrame(places, "lat double, lon double, dec double, hour double")
    lat, lon, dec, hour = map(F.col, df.columns)
    df = df.withColumns({"h": G.sun_altitude(lat, dec, hour), "e": G.satellite_elevation(lat, lon, 0.1), "b": G.satellite_azimuth(lat, lon, 0.1)})
    df = df.withColumn("a", G.sun_azimuth(lat, dec, hour, F.col("h")))
    both = [F.col(c) for c in ("a", "h", "b", "e")]
    for row in df.withColumns({"apart": G.between(*both), "mirror": G.between(*both, mirrored=True)}).collect():
        # the sun and the satellite as vectors from the place, in its east, north and up
        up = np.array([math.cos(row.lat) * math.cos(row.lon), math.cos(row.lat) * math.sin(row.lon), math.sin(row.lat)])
        east = np.array([-math.sin(row.lon), math.cos(row.lon), 0.0])
        axes = np.array([east, np.cross(up, east), up])
        far = row.lon - row.hour
        sun = axes @ np.array([math.cos(row.dec) * math.cos(far), math.cos(row.dec) * math.sin(far), math.sin(row.dec)])
        sat = axes @ (np.array([math.cos(0.1), math.sin(0.1), 0.0]) * G.ORBIT / G.RADIUS - up)
        sat /= np.linalg.norm(sat)
        assert _direction(row.a, row.h) == pytest.approx(sun, abs=1e-6)
        assert _direction(row.b, row.e) == pytest.approx(sat, abs=1e-9)
        assert math.cos(row.apart) == pytest.approx(float(sun @ sat), abs=1e-6)
        assert math.cos(row.mirror) == pytest.approx(float(sun * [-1, -1, 1] @ sat), abs=1e-6)


def test_declination_follows_the_year(spark):
    days = {r.d: r.x for r in spark.range(1, 366).select(F.col("id").alias("d"), F.degrees(G.declination(F.col("id"))).alias("x")).collect()}
    assert abs(max(days.values()) - 23.44) < 0.1 and abs(min(days.values()) + 23.44) < 0.1
    assert abs(max(days, key=days.get) - 172) < 5 and abs(days[80]) < 1 and abs(days[266]) < 1


def test_gates_and_edges(spark):
    d = math.radians
    rows = [(True, d(30), d(26)), (False, d(51), d(41)), (True, d(51), d(20)), (False, d(40), d(25)), (None, None, None)]
    df = spark.createDataFrame(rows, "land boolean, mirror double, glint double")
    got = df.select(G.glint_gate(F.col("land"), F.col("mirror"), F.col("glint")).alias("g"), G.satellite_gate(F.col("mirror"), F.lit(d(60))).alias("s"), G.mirror_gate(F.col("mirror")).alias("m")).collect()
    assert [r.g for r in got] == [True, True, False, False, False]
    assert [r.s for r in got] == [False, True, True, False, False]
    assert [r.m for r in got] == [True, True, True, True, False]


def test_thermal_stability_by_surface(spark):
    rows = [(True, 280.0, 270.0, 284.0, 240.0), (False, 280.0, 270.0, 284.0, 240.0), (False, 280.0, 270.0, 284.0, 270.0), (True, 280.0, None, 290.0, 1.0), (True, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "land boolean, a double, b double, c double, d double")
    assert [r[0] for r in df.select(P.thermal_stable(*map(F.col, df.columns))).collect()] == [True, False, True, False, False]


def test_low_cloud_composite_and_training_rows(spark):
    df = spark.createDataFrame([(230.0, 240.2, 210.0), (230.0, 200.0, 1.0), (230.0, 330.0, 1.0), (230.0, None, 1.0), (None, 240.0, float("nan"))], "fir double, lir double, mir double")
    got = [tuple(r) for r in df.select(*P.low_cloud_composite(*map(F.col, df.columns))).collect()]
    assert got[:4] == [(255 * 60.0, 255 * 80.0, 255 * 20.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (None, None, None)]
    assert got[4][:2] == (None, 255 * 80.0) and math.isnan(got[4][2])
    assert [r[0] for r in df.select(P.trainable([F.col("lir"), F.col("mir")])).collect()] == [True, True, True, False, False]
    assert [r[0] for r in df.select(P.trainable([F.col("lir")], single=True)).collect()] == [True, True, False, False, True]


def _by_cell(rows):
    cells = {}
    for r in sorted(rows, key=lambda r: r.t):
        cells.setdefault((r.lat_i, r.lon_i), []).append(r)
    return cells


def test_broad_snow_before_the_late_test(spark):
    cube = source.load_cube(spark, SF)
    flags = cube.select(*KEY, ((F.col("t") * 7 + F.col("lat_i") * 3 + F.col("lon_i")) % 9 == 0).alias("broad"))
    got = {(r.t, r.lat_i, r.lon_i): r.cls for r in classify.classify_broad(cube, flags).collect()}
    want, before = {}, {}
    for (lat, lon), rows in _by_cell(classify._with_class(cube, True).collect()).items():
        before |= {(r.t, lat, lon): r.cls for r in rows}
        free = [r.early == 0 and (r.t * 7 + lat * 3 + lon) % 9 != 0 for r in rows]
        at = lambda i: 0 <= i < len(rows) and free[i]  # noqa: E731, B023
        steady = [r.vis if all(at(i + k) for k in range(-2, 3)) else 100.0 for i, r in enumerate(rows)]
        smooth = [float(np.mean(steady[i - 4 : i + 1])) if i >= 4 else x for i, x in enumerate(steady)]
        background = {}
        for r, x in zip(rows, smooth, strict=True):
            background[r.slot] = min(x, background.get(r.slot, x))
        for i, r in enumerate(rows):
            late = free[i] and r.is_land and r.vis - background[r.slot] > 0.1
            want[r.t, lat, lon] = 4 if late else 3 if r.suspect and r.early == 1 else r.early
    assert got == want and len(got) == cube.count()
    nowhere = {tuple(r)[:3]: r.cls for r in classify.classify_broad(cube, flags.withColumn("broad", F.lit(False))).collect()}
    assert nowhere == before


def test_broad_snow_spares_late_clouds(spark):
    """A cell that is always free and once brighter than its background is a late cloud, unless it may be snow."""
    rows = [(t, 16071 + t // 4, t % 4, 0, 0, 285.0, 285.0, 285.0, 0.35, 0.6 if t == 21 else 0.2, True, 0.9, math.acos(0.9), 270.0) for t in range(40)]
    cube = spark.createDataFrame(rows, "t int, dfb int, slot int, lat_i int, lon_i int, fir double, lir double, mir double, sir double, vis double, is_land boolean, cosz double, zen double, t2m double")
    flags = cube.select(*KEY, (F.col("t") == 21).alias("broad"))
    plain = {r.t: r.cls for r in classify.classify(cube).collect()}
    broad = {r.t: r.cls for r in classify.classify_broad(cube, flags).collect()}
    assert plain[21] == 4 and broad[21] == 0 and set(plain) == set(broad)


@pytest.mark.parametrize("shades", [True, False])
def test_point_codes(spark, shades):
    cube = source.load_cube(spark, SF)
    flag = lambda t, i, j: (t * 5 + i * 3 + j) % 4 != 0
    bright = cube.select(*KEY, ((F.col("t") * 5 + F.col("lat_i") * 3 + F.col("lon_i")) % 4 != 0).alias("bright"))
    got = {(r.t, r.lat_i, r.lon_i): r.cls for r in classify.point_codes(cube, shades=shades, bright=bright).collect()}
    visible = {(r.t, r.lat_i, r.lon_i): r for r in classify.features(cube, "visible", "abstract").collect()}
    infrared = {(r.t, r.lat_i, r.lon_i): r for r in classify.features(cube, "infrared", "abstract").collect()}
    want = {}
    for (lat, lon), rows in _by_cell(cube.collect()).items():
        codes = []
        for r in rows:
            v, x = visible[r.t, lat, lon], infrared[r.t, lat, lon]
            code = 0  # in the order of writing
            if r.vis is not None and r.sir is not None and r.vis > 0.5 * r.zen and r.sir > 0.1 * r.zen:
                code = 3
            code = 13 if x.cli_eps is None else code
            code = 12 if v.sea else code
            b = flag(r.t, lat, lon)
            rises, falls, heavy = b and v.rise > 0.2, b and v.drop > 0.2, x.cli_variability > 10
            if b and not rises and not falls and not heavy and not x.cold:
                code = 5
            code = 6 if rises else code
            code = 7 if falls else code
            code = 1 if heavy else code
            code = 2 if x.cli_eps is not None and x.cli_eps > 0.2 else code
            codes.append(8 if x.cold else code)
        for i, r in enumerate(rows):
            free = [q.vis for q, c in zip(rows, codes, strict=True) if q.slot == r.slot and c in (0, 5) and q.vis is not None]
            dark = codes[i] in (0, 5) and r.vis is not None and bool(free) and float(np.median(free)) - r.vis > 0.2 * r.cosz
            want[r.t, lat, lon] = 11 if shades and dark else codes[i]
    assert got == want
    assert {1, 2, 5, 7, 8, 13} & set(want.values()) and (11 in want.values()) == shades


def test_point_codes_take_the_rim(spark):
    cube = source.load_cube(spark, SF)
    ndsi = classify.features(classify.with_indexes(cube), "visible", "abstract").select(*KEY, (F.col("ndsi") < 0.3).alias("under"))
    rim = tiles.watershed_volume(ndsi, "under").select(*KEY, F.col("rim").alias("bright"))
    a = {tuple(r) for r in classify.point_codes(cube).collect()}
    assert a == {tuple(r) for r in classify.point_codes(cube, bright=rim, size=(8, 3, 3)).collect()} and len(a) == cube.count()


def test_fixed_flags_dilate_once(spark):
    cube = source.load_cube(spark, SF)
    want = neighbourhood.dilate(cube.drop("near_land"), "is_land", "wide").select(*KEY, "wide")
    got = neighbourhood.dilate_fixed(cube.drop("near_land"), "is_land", "wide").select(*KEY, "wide")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} == {tuple(r) for r in cube.select(*KEY, "near_land").collect()}
    none = spark.createDataFrame([(0, 0, 0, None), (0, 0, 1, False)], "t int, lat_i int, lon_i int, is_land boolean")
    assert [r.wide for r in neighbourhood.dilate_fixed(none, "is_land", "wide").collect()] == [False, False]
    assert neighbourhood.dilate_fixed(none.limit(0), "is_land", "wide").count() == 0
