"""Cube sink and source, models and filters against plain versions and invariants; a seven-day cube made by hand."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rasterloom.config import Profile
from rasterloom.operators import classify, models, patterns, segment, spectrum, timeseries
from rasterloom.sources import cube as source

SF = "/root/testdata/sf0.01"
KEY = ["t", "lat_i", "lon_i"]


def test_cube_round_trip_prunes(spark, tmp_path):
    cube = source.load_cube(spark, SF).select(*KEY, "dfb", "slot", "vis", "lir")
    path = str(tmp_path / "cube")
    source.write_cube(cube, path)
    got = source.read_cube(spark, path, days=(16073, 16075), lats=(1, 3), slot_step=2, columns=[*KEY, "vis"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "dfb" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "lir" not in plan.split("ReadSchema")[1]
    want = cube.filter("dfb between 16073 and 16075 and lat_i between 1 and 3 and slot % 2 = 0").select(*KEY, "vis")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert source.in_range(cube, ["vis", "lir"], 0, 350).first().asDict() == {"vis": True, "lir": True}


def _week(spark, values):
    """One cell, one slot a day for seven days."""
    return spark.createDataFrame([(i, 100 + i, 0, 0, 0, x) for i, x in enumerate(values)], "t int, dfb int, slot int, lat_i int, lon_i int, x double")


def test_variability_on_a_week(spark):
    x = [1.0, 4.0, 2.0, 8.0, None, 8.5, 3.0]
    got = [r[0] for r in _week(spark, x).select("t", timeseries.total_variability(F.col("x"), 100, 106).alias("v")).orderBy("t").select("v").collect()]
    want = []
    for i, v in enumerate(x):
        near = [j for j in range(7) if j != i and abs(i - j) <= (3 if 2 <= i <= 4 else 2)]
        want.append(min(-10.0 if v is None or x[j] is None else abs(v - x[j]) for j in near))
    assert got == want
    lasting = [r[0] for r in _week(spark, x).select("t", timeseries.lasting_rise(F.col("x"), 100, 106).alias("v")).orderBy("t").select("v").collect()]
    assert lasting == [max(0.0, min(-10.0 if v is None or x[j] is None else v - x[j] for j in range(7) if 0 < abs(i - j) <= 2)) for i, v in enumerate(x)]


def test_late_background_on_a_week(spark):
    """Bright views next to cloud don't make the background; steadily free ones do."""
    free = [True] * 12 + [False] + [True] * 15
    rows = [(i, i // 4, i % 4, 0, 0, 0.2 + 0.01 * i, f) for i, f in enumerate(free)]
    df = spark.createDataFrame(rows, "t int, dfb int, slot int, lat_i int, lon_i int, vis double, free boolean")
    got = {r.t: r.background for r in classify.late_background(df, "vis", "free").collect()}
    steady = [0.2 + 0.01 * i if all(0 <= i + d < 28 and free[i + d] for d in (-2, -1, 0, 1, 2)) else 100.0 for i in range(28)]
    smooth = [sum(steady[i - 4 : i + 1]) / 5 if i >= 4 else steady[i] for i in range(28)]
    for i in range(28):
        assert abs(got[i] - min(smooth[j] for j in range(28) if j % 4 == i % 4)) < 1e-9


def test_slices_start_at_the_darkest_slot(spark):
    rows = [(t, t // 8, 0, 0, float((t - 3) % 8)) for t in range(40)]
    df = spark.createDataFrame(rows, "t int, dfb int, lat_i int, lon_i int, cosz double")
    got = {r.t: r.slice for r in patterns.with_slices(df, 8, 0).collect()}
    assert got == {t: (t - 3) // 8 + 1 for t in range(40)}
    assert abs(sum(patterns.kernel(1.5, 2)) - 1) < 1e-12 and len(patterns.kernel(1.5, 2)) == 7


def test_regions_and_low_pass(spark):
    cube = source.load_cube(spark, SF)
    bright = {(r.t, r.lat_i, r.lon_i) for r in cube.filter("vis > 0.25").select(*KEY).collect()}
    got = {(r.t, r.lat_i, r.lon_i): r.region for r in segment.regions(cube.withColumn("b", F.coalesce(F.col("vis") > 0.25, F.lit(False))), "b").collect()}
    assert set(got) == bright
    up = {c: c for c in bright}
    for _ in range(30):  # smallest cell reachable
        up = {(t, i, j): min([up[t, i, j]] + [up[n] for n in ((t, i + 1, j), (t, i - 1, j), (t, i, j + 1), (t, i, j - 1)) if n in up]) for t, i, j in up}
    pairs = {((c[0], got[c]), up[c]) for c in bright}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    smooth = {(r.t, r.lat_i, r.lon_i): r.smooth for r in spectrum.low_pass(cube, "vis", 2.0, (5, 5)).filter("t < 6").collect()}
    grid = np.zeros((6, 5, 5))
    for r in cube.filter("t < 6").collect():
        grid[r.t, r.lat_i, r.lon_i] = r.vis or 0.0
    w = np.exp(-2j * np.pi * np.outer(range(5), range(5)) / 5)
    for t in range(6):
        f = w @ grid[t] @ w
        f[np.abs(f) >= 2.0] = 0
        back = (w.conj() @ f @ w.conj()).real / 25
        assert all(abs(smooth[t, i, j] - back[i, j]) < 1e-9 for i in range(5) for j in range(5))


def test_tapered_low_pass(spark):
    rng = np.random.default_rng(5)
    grid = rng.normal(size=(3, 4, 7))
    cells = [(t, i, j, float(grid[t, i, j])) for t in range(3) for i in range(4) for j in range(7)]
    grid[1, 2, 3] = grid[2, 0, 0] = 0.0
    cells = [(t, i, j, None if (t, i, j) == (1, 2, 3) else x) for t, i, j, x in cells if (t, i, j) != (2, 0, 0)]
    cube = spark.createDataFrame([(*c, "x", 1.0) for c in cells], "t int, lat_i int, lon_i int, x double, re string, smooth double")
    got = {(r.t, r.lat_i, r.lon_i): r.smooth for r in spectrum.low_pass(cube, "x", 4.0, (4, 7), 1.5).collect()}
    assert len(got) == 84
    for t in range(3):
        f = np.fft.fft2(grid[t])
        m = np.abs(f)
        share = np.where(m <= 2.5, 1.0, np.where(m >= 5.5, 0.0, 0.5 * (1 - np.sin(np.pi * (m - 4.0) / 3.0))))
        assert 0 < ((share > 0) & (share < 1)).sum()
        back = np.fft.ifft2(f * share).real
        assert all(abs(got[t, i, j] - back[i, j]) < 1e-9 for i in range(4) for j in range(7))
    assert spectrum.low_pass(cube.limit(0), "x", 4.0, (4, 7)).count() == 0
    with pytest.raises(ValueError):
        spectrum.low_pass(cube, "x", 4.0, (4, 7), -1.0)


def test_neighbours_in_blocks(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = v.filter("vec_id % 50 = 0")
    once, blocks = (sorted(map(tuple, models.knn_vote(v, q, block=b).collect())) for b in (2048, 3))
    assert once == blocks and len(once) == q.count()
    assert models.knn_vote(v, q.limit(0)).count() == 0
    assert sorted(map(tuple, models.centroid_vote(v).collect())) == sorted(map(tuple, models.centroid_vote(v, limit=0).collect()))


def test_neighbours_of_many_queries(spark):
    """The plan and a task's memory do not grow with the queries; the rows are those of a plain sort, ties and copies included."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(600, 4)), 1).astype(np.float32)
    x[100:400:3] = x[0]
    label = rng.integers(0, 4, 600)
    v = spark.createDataFrame([(i, a.tolist(), int(c)) for i, (a, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").repartition(3)
    found = models.knn_vote(v, v.filter("vec_id % 2 = 0"), block=10)
    assert str(found._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1
    for r in found.collect():
        d = np.round(((x.astype(float) - x[r.vec_id].astype(float)) ** 2).sum(axis=1), 6)
        d[r.vec_id] = np.inf
        n = np.bincount(label[np.lexsort((np.arange(600), d))[:7]], minlength=4)
        assert (r.label, r.predicted) == (label[r.vec_id], n.argmax())


def test_neighbours_hold_little():
    """2,048 queries against 8 x 1,024 rows: less than 80 MB at once (150 before, with all distances and their order)."""
    import tracemalloc

    rng = np.random.default_rng(9)
    q, x = rng.normal(size=(2048, 64)), rng.normal(size=(8192, 64))
    flat = pa.array(x.ravel())
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(8192)), pa.array(np.zeros(8192, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, 8193 * 64, 64), pa.int32()), flat)], names=["vec_id", "label", "x"])
    shared = type("Shared", (), {"value": [(np.arange(2048) + 10_000, q)]})
    tracemalloc.start()
    rows = sum(b.num_rows for b in models._nearest(shared, 7)([batch]))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == 2048 * 7 and peak < 80


@pytest.mark.parametrize("kind", ["forest", "bayes", "perceptron", "tree"])
def test_classifiers_learn(spark, kind):
    """Three groups of vectors apart from one another (the given tables' labels do not depend on the vectors)."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(2.0 * (i % 3), 0.5, 4)], i % 3) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = models.accuracy(models.classify(df, kind).filter("vec_id % 5 = 0")).first()
    assert got.n == 48 and got.accuracy >= 0.9


def test_mixtures_are_ordered(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.3, 200) for m in (-4, 0, 5)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    by_value = {r.x: r.grade for r in models.cloud_covertness(df, "x").collect()}
    assert all(by_value[v] == (2 if v < -2 else 0 if v < 2.5 else 1) for v in by_value)
    dark = spark.createDataFrame([(float(v),) for v in rng.normal(0.2, 0.05, 300)], "vis double")
    assert all(r.grade == int(r.vis > 0.35) for r in models.brightness(dark).collect())
    assert {r.grade for r in models.brightness_variability(df, "x").collect()} == {0, 1}
    assert models.components_apart([(0.0, 1.0), (5.0, 1.0)]) and not models.components_apart([(0.0, 1.0), (0.5, 1.0)])


def test_clusters_and_projection(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    sizes = models.cluster(v, 10).groupBy("cluster").count().collect()
    assert len(sizes) == 10 and sum(r["count"] for r in sizes) == v.count()
    pc = np.array([r.pc for r in models.project(v).collect()])
    assert (np.diff(pc.var(axis=0)) <= 1e-9).all()
    assert Profile().days == 30
