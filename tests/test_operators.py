"""Operators on hand-made cubes: edges, gaps, ties, empty input."""

import math

import pytest
from pyspark.sql import functions as F
from rasterloom.config import Profile
from rasterloom.functions import physics
from rasterloom.operators import classify, models, navigation, neighbourhood, segment, stats, timeseries
from rasterloom.streaming import live_cube

SCHEMA = "t int, dfb int, slot int, lat_i int, lon_i int, vis double"


def series(spark, values, spd=1):
    return spark.createDataFrame([(i, i // spd, i % spd, 0, 0, v) for i, v in enumerate(values)], SCHEMA)


def column(df, c):
    return [r[c] for r in df.orderBy("t").collect()]


@pytest.mark.parametrize("days", range(1, 8))
def test_day_variability(spark, days):
    x = [float((i * 7) % 5) for i in range(days)]
    got = series(spark, x).withColumns({"up": timeseries.positive_variability(F.col("vis")), "down": timeseries.negative_variability(F.col("vis")), "last": timeseries.lasting_rise(F.col("vis"), 0, days - 1)})
    near = lambda i: [x[j] for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < days]
    assert column(got, "up") == [max([0.0] + [x[i] - y for y in near(i)]) for i in range(days)]
    assert column(got, "down") == [max([0.0] + [y - x[i] for y in near(i)]) for i in range(days)]
    assert column(got, "last") == [max(0.0, min([x[i] - y for y in near(i)], default=-10.0)) for i in range(days)]


def test_one_missing_day(spark):
    got = series(spark, [1.0, None, 5.0, 4.0, 2.0]).withColumns({"up": timeseries.positive_variability(F.col("vis")), "last": timeseries.lasting_rise(F.col("vis"), 0, 4), "all": timeseries.total_variability(F.col("vis"), 0, 4)})
    assert column(got, "up") == [0.0, 0.0, 4.0, 2.0, 0.0]
    assert column(got, "last") == [0.0, 0.0, 0.0, 0.0, 0.0]
    assert column(got, "all") == [-10.0, -10.0, -10.0, -10.0, 2.0]


@pytest.mark.parametrize("days", range(1, 10))
def test_total_variability_rule(spark, days):
    """Against the rule of SURVEY V3: three days away counts from six days on, for days 2 to n - 3."""
    x = [float(v) if v is not None else None for v in (0, 10, 20, 1, 30, 40, None, 55, 21.5)][:days]

    def want(i):
        if days < 2 or (days == 4 and i in (1, 2)):
            return -10.0
        lags = (1, 2, 3) if days >= 6 and 2 <= i <= days - 3 else (1, 2)
        near = [j for k in lags for j in (i - k, i + k) if 0 <= j < days]
        return min(-10.0 if x[i] is None or x[j] is None else abs(x[i] - x[j]) for j in near)

    got = series(spark, x).withColumn("all", timeseries.total_variability(F.col("vis"), 0, days - 1))
    assert column(got, "all") == [want(i) for i in range(days)]


def test_late_cloud_needs_a_steady_background(spark):
    """A dark free view beside a cloud is no background; a view far brighter than the steady ones is class 4."""
    vis = {14: 0.05, 20: 0.4}
    rows = [(t, t // 4, t % 4, 0, 1, 290.0, 250.0 if t == 15 else 290.0, 292.0, vis.get(t, 0.2), vis.get(t, 0.2), 0.9, 0.45, 290.0, True) for t in range(24)]
    cube = spark.createDataFrame(rows, "t int, dfb int, slot int, lat_i int, lon_i int, fir double, lir double, mir double, sir double, vis double, cosz double, zen double, t2m double, is_land boolean")
    assert column(classify.classify(cube), "cls") == [{15: 2, 20: 4}.get(t, 0) for t in range(24)]
    got = column(classify.unstable_albedo(cube), "background")
    assert all(math.isclose(b, 0.2) for b in got)


def test_low_cut_is_a_butterworth(spark):
    """The power gain of its impulse response is 1 / (1 + (tan(c pi / 2) / tan(w / 2)) ** 16); a missing value gives 0."""
    y = column(timeseries.low_cut(series(spark, [1.0] + [0.0] * 399), "vis", 0.1), "filtered")
    for f in (0.03, 0.07, 0.1, 0.13, 0.5, 0.9):
        w = f * math.pi
        gain = sum(v * math.cos(w * i) for i, v in enumerate(y)) ** 2 + sum(v * math.sin(w * i) for i, v in enumerate(y)) ** 2
        assert math.isclose(gain, 1 / (1 + (math.tan(0.05 * math.pi) / math.tan(w / 2)) ** 16), rel_tol=1e-6, abs_tol=1e-8)
    assert column(timeseries.low_cut(series(spark, [1.0, None, 0.0]), "vis", 0.1), "filtered") == [y[0], 0.0, y[2]]


def test_gaps(spark):
    x = [None, 1.0, None, 3.0, None, None, 6.0, None, None, None, 10.0, None, None, None, None, 15.0, None]
    got = timeseries.interpolate_gaps(series(spark, x), "vis")
    want = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None, None, None, None, 15, None]
    assert column(got, "filled") == pytest.approx(want)
    assert column(timeseries.missing_runs(series(spark, x), "vis"), "run_length") == [1, 1, 1, 1, 2, 2, 1, 3, 3, 3, 1, 4, 4, 4, 4, 1, 1]
    assert column(timeseries.interpolate_gaps(series(spark, x), "vis", method="keep-last"), "filled")[4:6] == [3.0, 3.0]


def grid(spark, f, n=3):
    return spark.createDataFrame([(0, 0, 0, i, j, float(f(i, j))) for i in range(n) for j in range(n)], SCHEMA)


def test_neighbourhoods(spark):
    f = lambda i, j: i * 3 + j * j
    got = {(r.lat_i, r.lon_i): r for r in neighbourhood.contrast(neighbourhood.local_std(grid(spark, f), "vis", "sd"), "vis", "con").collect()}
    clip = lambda i: min(max(i, 0), 2)
    for (i, j), r in got.items():
        box = [f(clip(i + a), clip(j + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        mean = sum(box) / 9
        assert r.sd == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in box) / 9))
        assert r.con == pytest.approx(f(i, j) * 9 / 8 - sum(box) / 8)
    flags = grid(spark, lambda i, j: i == 0 and j == 0, 4).withColumn("on", F.col("vis") > 0)
    assert {(r.lat_i, r.lon_i) for r in neighbourhood.dilate(flags, "on", "wide").filter("wide").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    p = Profile(n_lat=3, n_lon=3)
    medians = {(r.lat_i, r.lon_i): r.m for r in neighbourhood.median_filter(grid(spark, f), "vis", "m", p=p).collect()}
    for (i, j), m in medians.items():
        assert m == sorted(f(clip(i + a), clip(j + b)) for a in (-1, 0, 1) for b in (-1, 0, 1))[4]


def test_otsu_and_regions(spark):
    two = grid(spark, lambda i, j: 10 if i < 2 else 200, 4)
    limit = segment.otsu(two, "vis", ["t"]).first().threshold
    assert 10 < limit < 200
    assert segment.otsu(grid(spark, lambda i, j: 5, 4), "vis", ["t"]).first().threshold is None
    found = segment.regions(grid(spark, lambda i, j: (i + j) % 2 == 0 or i == 0, 3).withColumn("on", F.col("vis") > 0), "on").collect()
    assert len({r.region for r in found}) == 3


def test_gates_are_open(spark):
    zen = spark.createDataFrame([(math.radians(d),) for d in (0, 15, 80, 85, 89, 90)], "z double")
    got = zen.select(*(physics.gate(F.col("z"), k).alias(k) for k in ("dawn_day", "day", "twilight"))).collect()
    assert [tuple(r) for r in got] == [(False, False, False), (True, False, False), (True, True, False), (False, False, True), (False, False, True), (False, False, False)]


def test_navigation(spark):
    points = spark.createDataFrame([(0.0, 0.0), (45.0, 30.0), (-60.0, -40.0)], "lat double, lon double")
    y, x = navigation.ll_to_angles(F.col("lat"), F.col("lon"), 0.0)
    lat, lon = navigation.angles_to_ll(F.col("y"), F.col("x"), 0.0)
    for r in points.withColumn("y", y).withColumn("x", x).select("lat", "lon", lat.alias("a"), lon.alias("b")).collect():
        assert (r.a, r.b) == pytest.approx((r.lat, r.lon), abs=1e-6)
    assert spark.range(1).select(navigation.angles_to_ll(F.lit(0.4), F.lit(0.0), 0.0)[0].alias("a")).first().a is None
    row = spark.createDataFrame([([1, 2, 3],)], "d array<bigint>").select(navigation.encode_labels(F.col("d")).alias("c"))
    assert row.first().c == 1 + 2 * 6 + 3 * 36 and row.select(navigation.decode_labels(F.col("c"), 3).alias("d")).first().d == [1, 2, 3]


def test_empty_cube(spark):
    none = series(spark, [1.0]).limit(0)
    assert timeseries.interpolate_gaps(none, "vis").count() == 0
    assert segment.otsu(none, "vis", ["t"]).count() == 0
    assert neighbourhood.local_std(none, "vis", "sd").count() == 0
    assert stats.pixel_correlation(none, "vis", "vis").count() == 0


def test_models(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert models.accuracy(models.classify(data, "forest")).first().accuracy > 0.5


def test_stream_equals_batch(spark, tmp_path):
    events = live_cube.read_events(spark, "/root/testdata/sf0.001/")
    run = live_cube.slot_means(events).writeStream.outputMode("complete").format("memory").queryName("slots").start()
    run.processAllAvailable()
    run.stop()
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    want = batch.groupBy(F.window("ts", "6 hours").start.alias("start"), (F.col("user_id") % 25).cast("int").alias("cell"), "event_type").agg(F.count("*").alias("n"))
    got = spark.table("slots").select("start", "cell", "event_type", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
