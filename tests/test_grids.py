"""Whole-slot operators against grids drawn by hand and plain versions."""

import math

import numpy as np
from pyspark.sql import functions as F
from rasterloom.config import Profile
from rasterloom.operators import classify, grids, stats

RNG = np.random.default_rng(7)


def _frame(spark, columns, kinds):
    """One row for each cell of one slot; NaN becomes null."""
    first = next(iter(columns.values()))
    rows = [(0, i, j, *(None if isinstance(g[i, j].item(), float) and math.isnan(g[i, j]) else g[i, j].item() for g in columns.values())) for i in range(first.shape[0]) for j in range(first.shape[1])]
    return spark.createDataFrame(rows, "t int, lat_i int, lon_i int, " + ", ".join(f"{c} {k}" for c, k in zip(columns, kinds, strict=True)))


def _back(df, shape, out):
    grid = np.zeros(shape, dtype=object)
    for r in df.collect():
        grid[r.lat_i, r.lon_i] = r[out]
    return grid


def _draw(*lines):
    return np.array([[c == "#" for c in line] for line in lines])


def test_distance():
    for _ in range(20):
        a = RNG.random((6, 9)) < 0.8
        off = np.argwhere(~a)
        want = np.array([[min(math.dist((i, j), o) for o in off) if a[i, j] else 0 for j in range(9)] for i in range(6)])
        assert np.allclose(grids._distance(a), want)


def test_watershed_keeps_thin_parts(spark):
    flag = _draw(
        "..........",
        ".#####....",
        ".#####....",
        ".##########"[:10],
        ".#####....",
        ".#####....",
        "..........",
    )
    rim = grids.outer_rim(flag, 0.3)
    assert rim[3, 9] and rim[3, 7] and not rim[3, 3] and not rim[~flag].any()
    x = np.where(flag, 1.0, 5.0)
    shape = Profile(n_lat=7, n_lon=10)
    for how, static in (("otsu", None), ("static", 3.0)):
        got = _back(grids.watershed(_frame(spark, {"x": x}, ["double"]), "x", how, static=static, p=shape), flag.shape, "rim")
        assert (got == rim).all()
    assert not _back(grids.watershed(_frame(spark, {"x": np.zeros((7, 10))}, ["double"]), "x", p=shape), flag.shape, "rim").any()
    assert not _back(grids.watershed(_frame(spark, {"x": np.zeros((7, 10))}, ["double"]), "x", "binary", p=shape), flag.shape, "rim").any()


def _plain_mean(seeds, x):
    out, left = np.zeros(x.shape), {tuple(c) for c in np.argwhere(seeds)}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            c = todo.pop()
            group.add(c)
            near = {d for d in left if max(abs(c[0] - d[0]), abs(c[1] - d[1])) == 1}
            left -= near
            todo += near
        values = [x[c] for c in group if not math.isnan(x[c])]
        for c in group:
            out[c] = sum(values) / len(values) if values else 0
    h, w = x.shape
    return np.array([[max(out[a, b] for a in range(max(0, i - 1), min(h, i + 2)) for b in range(max(0, j - 1), min(w, j + 2))) for j in range(w)] for i in range(h)])


def test_region_mean_and_growth(spark):
    seeds, lir, vis = RNG.random((8, 9)) < 0.3, np.round(RNG.random((8, 9)) * 10 + 270, 3), np.round(RNG.random((8, 9)), 3)
    lir[2, 3] = lir[5, 5] = np.nan
    got = _back(grids.region_mean(_frame(spark, {"s": seeds, "x": lir}, ["boolean", "double"]), "s", "x", "m"), seeds.shape, "m").astype(float)
    assert np.allclose(got, _plain_mean(seeds, lir)) and np.allclose(grids._means(seeds, lir), _plain_mean(seeds, lir))

    seeds = _draw("####.....", "####.....", "####.....", "####.....", ".......##", ".........", ".........", ".........")
    lir, vis, may = np.full((8, 9), 280.0), np.full((8, 9), 0.2), np.full((8, 9), True)
    vis[:, 4:] = 0.4  # brighter beside the seeds: grows eastwards until the mean has caught up
    may[0, 5] = False
    lir[1, 3:] = np.nan
    got = _back(grids.grow(_frame(spark, {"s": seeds, "vis": vis, "lir": lir, "may": may}, ["boolean", "double", "double", "boolean"]), "s", "vis", "lir", "may", p=Profile(n_lat=8, n_lon=9)), seeds.shape, "grown")
    want = np.array([[all(seeds[a, b] for a in range(max(0, i - 1), min(8, i + 2)) for b in range(max(0, j - 1), min(9, j + 2))) for j in range(9)] for i in range(8)])
    while True:
        warm, bright = _plain_mean(want, lir), _plain_mean(want, vis)
        new = {(i, j) for i in range(8) for j in range(9) if not want[i, j] and may[i, j] and want[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2].any()
               and warm[i, j] - 5 < lir[i, j] < warm[i, j] + 0.5 and vis[i, j] > 1.05 * bright[i, j]}
        if not new:
            break
        for c in new:
            want[c] = True
    assert (got == want).all() and not got[4, 7]


def test_local_otsu_plain(spark):
    gray = np.floor(RNG.random((6, 7)) * 5) * 10
    gray[1, 1] = np.nan
    want = np.zeros(gray.shape, dtype=bool)
    for i, j in np.ndindex(gray.shape):
        v = [gray[c] for c in np.ndindex(gray.shape) if math.dist(c, (i, j)) <= 2 and not math.isnan(gray[c])]
        best = None
        for k in sorted(set(v))[:-1]:
            low, high = [x for x in v if x <= k], [x for x in v if x > k]
            score = round(len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2, 3)
            best = max(best, (score, -k)) if best else (score, -k)
        want[i, j] = best is not None and gray[i, j] > -best[1]
    got = _back(grids.local_otsu(_frame(spark, {"x": gray}, ["double"]), "x", 2, size=(1, 4, 4)), gray.shape, "above")
    assert (got == want).all()


def test_warm_ground_and_lags(spark):
    rows = [(d * 4 + s, d, s, 0, 0, 300.0 if d == 1 and s == 2 else None if d == 2 else 270.0, d == 3) for d in range(4) for s in range(4)]
    cube = spark.createDataFrame(rows, "t int, dfb int, slot int, lat_i int, lon_i int, mir double, cloudy boolean")
    got = {r.t: r.warm for r in classify.warm_ground(cube, "cloudy", 280.0).collect()}
    assert [t for t in got if got[t]] == [4, 5, 6, 7]
    wave = [(t, t // 24, 0, 0, math.sin(t / 4), math.sin((t - 2) / 4) + 3) for t in range(48)]
    frame = spark.createDataFrame(wave, "t int, dfb int, lat_i int, lon_i int, c double, x double")
    assert [tuple(r) for r in stats.peak_lags(frame, "x", "c", 5).collect()] == [(2, 2)]
    assert stats.peak_lags(frame.withColumn("x", F.lit(1.0)), "x", "c", 5).count() == 0
