"""Tiles with halos against whole-array versions, for several sizes of tile."""

import heapq
import itertools
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterloom.config import Profile
from rasterloom.operators import graph, tiles

RNG = np.random.default_rng(11)
SHAPE = (3, 7, 9)
P = Profile(n_lat=SHAPE[1], n_lon=SHAPE[2])
SIZES = [(16, 64, 64), (1, 2, 3), (2, 3, 4)]


def _frame(spark, columns, keep=None):
    """A row for each cell (of `keep`); NaN becomes null; a column of a clashing name on top."""
    kinds = {"b": "boolean", "f": "double", "i": "int"}
    where = list(np.ndindex(SHAPE)) if keep is None else [tuple(x) for x in np.argwhere(keep)]
    value = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    rows = [(*map(int, i), *(value(a[i].item()) for a in columns.values()), "x") for i in where]
    return spark.createDataFrame(rows, "t int, lat_i int, lon_i int, " + ", ".join(f"{c} {kinds[a.dtype.kind]}" for c, a in columns.items()) + ", origin string")


def _back(df, out):
    return {(r.t, r.lat_i, r.lon_i): r[out] for r in df.select("t", "lat_i", "lon_i", out).collect()}


def _mirror(i, n):
    return -i - 1 if i < 0 else 2 * n - 1 - i if i >= n else i


def _box(a, t, i, j, scope):
    r = scope // 2
    return [a[t, _mirror(i + y, SHAPE[1]), _mirror(j + x, SHAPE[2])] for y in range(-r, r + 1) for x in range(-r, r + 1)]


@pytest.mark.parametrize("size", [(16, 64, 64), (2, 4, 3)])
@pytest.mark.parametrize("scope", [1, 3, 5])
def test_masked_boxes(spark, size, scope):
    a, m = RNG.random(SHAPE), RNG.random(SHAPE) < 0.1
    df = _frame(spark, {"x": a, "m": m})
    masked = {c: any(0 <= c[1] + y < SHAPE[1] and 0 <= c[2] + x < SHAPE[2] and m[c[0], c[1] + y, c[2] + x] for y, x in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))) for c in np.ndindex(SHAPE)}
    for op, plain in ((tiles.local_std, statistics.pstdev), (tiles.local_max, max)):
        got = _back(op(df, "x", "y", scope, "m", P, size), "y")
        free = _back(op(df, "x", "y", scope, None, P, size), "y")
        for c in np.ndindex(SHAPE):
            assert free[c] == pytest.approx(plain(_box(a, *c, scope)), abs=1e-12)
            assert got[c] == (-10.0 if masked[c] else free[c])
    with pytest.raises(ValueError):
        tiles.local_std(df, "x", "y", 4)


@pytest.mark.parametrize("size", SIZES)
def test_patches(spark, size):
    a = RNG.random(SHAPE)
    a[1, 2, 3] = np.nan
    got = _back(tiles.patches(_frame(spark, {"x": a}), "x", "p", (3, 3, 5), size), "p")
    padded = np.pad(np.where(np.isnan(a), -1.0, a), ((1, 1), (1, 1), (2, 2)), constant_values=-1.0)
    for t, i, j in np.ndindex(SHAPE):
        assert got[t, i, j] == padded[t : t + 3, i : i + 3, j : j + 5].ravel().tolist()


def _plain_regions(flag, over_time, diagonal):
    number, out = {c: (c[0] * tiles.ROW + c[1]) * tiles.ROW + c[2] for c in np.ndindex(SHAPE)}, {}
    near = lambda a, b: max(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 and (over_time or a[0] == b[0]) and (diagonal or sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1)
    cells = {c for c in np.ndindex(SHAPE) if flag[c]}
    for c in sorted(cells):
        if c in out:
            continue
        stack = [c]
        while stack:
            x = stack.pop()
            if x not in out:
                out[x] = number[c]
                stack += [y for y in cells if y not in out and near(x, y)]
    return out


@pytest.mark.parametrize(("over_time", "diagonal"), [(False, False), (False, True), (True, False), (True, True)])
def test_regions_are_the_same_for_any_tile(spark, over_time, diagonal):
    snake = np.zeros(SHAPE, bool)
    snake[:, ::2] = True
    snake[0, 1, -1] = snake[0, 3, 0] = snake[0, 5, -1] = True
    for flag in (RNG.random(SHAPE) < 0.45, snake):
        want = _plain_regions(flag, over_time, diagonal)
        for size in SIZES:
            assert _back(tiles.regions(_frame(spark, {"f": flag}), "f", over_time, diagonal, size), "first") == want
    none = tiles.regions(_frame(spark, {"f": np.zeros(SHAPE, bool)}), "f", over_time, diagonal)
    assert none.count() == 0


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100), (7, 200), (300, 301), (301, 300)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 200: 0, 300: 300, 301: 300}


def _plain_rim(back, coherence):
    """The same order of ways, cell by cell."""
    cells = list(np.ndindex(SHAPE))
    beside = lambda c: [n for n in ((c[0] + a, c[1] + b, c[2] + d) for a, b, d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))) if all(0 <= x < s for x, s in zip(n, SHAPE, strict=True))]
    eroded = {c: all(back[n] for n in [c, *beside(c)]) for c in cells}
    opened = {c: any(eroded[n] for n in [c, *beside(c)]) for c in cells}
    off = [c for c in cells if not opened[c]]
    if not off or len(off) == len(cells):
        return {c: bool(back[c] and off) for c in cells}, opened, None
    square = {c: min(sum((x - y) ** 2 for x, y in zip(c, o, strict=True)) for o in off) for c in cells}
    top = max(math.sqrt(d) for d in square.values())
    height = {c: -math.sqrt(square[c]) for c in cells}
    kind = {c: 1 if opened[c] and math.sqrt(square[c]) > coherence * top else 0 for c in cells if back[c] and (not opened[c] or math.sqrt(square[c]) > coherence * top)}
    over, queue = {}, [(height[c], c) for c in kind]
    heapq.heapify(queue)
    while queue:
        h, c = heapq.heappop(queue)
        if c not in over:
            over[c] = h
            for n in beside(c):
                if back[n] and n not in over:
                    heapq.heappush(queue, (max(h, height[n]), n))
    way, queue = {}, [(0, k, c) for c, k in kind.items()]
    heapq.heapify(queue)
    while queue:
        steps, k, c = heapq.heappop(queue)
        if c not in way:
            way[c] = k
            for n in beside(c):
                if back[n] and max(over[c], height[n]) == over[n]:
                    heapq.heappush(queue, (steps + 1, k, n))
    return {c: way.get(c) == 0 for c in cells}, opened, square


@pytest.mark.parametrize("size", [(16, 64, 64), (2, 3, 4)])
def test_watershed_volume(spark, size):
    blobs = np.zeros(SHAPE, bool)
    blobs[:, 1:6, 1:5] = blobs[:, 3, 4:] = blobs[1, 2:5, 6:] = True
    for back in (blobs, RNG.random(SHAPE) < 0.85, np.ones(SHAPE, bool), np.zeros(SHAPE, bool)):
        want, opened, square = _plain_rim(back, 0.3)
        df = _frame(spark, {"b": back})
        assert _back(tiles.opened(df, "b", "o", size), "o") == opened
        if square:
            marked = _frame(spark, {"o": np.array([opened[c] for c in np.ndindex(SHAPE)]).reshape(SHAPE)})
            assert _back(tiles.squared_distance(marked, "o", "d"), "d") == square
        assert _back(tiles.watershed_volume(df, "b", 0.3, size=size), "rim") == want


def test_holes_and_odd_rows(spark):
    """Cells that the cube lacks, missing values, and an empty cube."""
    a, keep = RNG.random(SHAPE), RNG.random(SHAPE) < 0.8
    a[0, 0, 0] = np.nan
    got = _back(tiles.patches(_frame(spark, {"x": a}, keep), "x", "p", (1, 3, 3), (2, 2, 2)), "p")
    padded = np.pad(np.where(keep & ~np.isnan(a), a, -1.0), ((0, 0), (1, 1), (1, 1)), constant_values=-1.0)
    assert set(got) == {tuple(map(int, c)) for c in np.argwhere(keep)}
    assert all(got[t, i, j] == padded[t, i : i + 3, j : j + 3].ravel().tolist() for t, i, j in got)
    empty = _frame(spark, {"x": a}, keep).filter(F.lit(False))
    assert tiles.patches(empty, "x", "p", (1, 3, 3)).count() == 0
    for shape in itertools.product((2, 3), repeat=3):
        if 2 in shape:
            with pytest.raises(ValueError):
                tiles.patches(empty, "x", "p", shape)
