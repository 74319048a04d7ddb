"""Operators that need a slot's whole grid: watershed, connected seeds and their growth; local thresholds, by tiles.

Slots are dealt over the cluster; a task holds one slot's grid at a time, whose size is the instrument's.
Cells that a slot lacks count as missing.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Profile
from . import neighbourhood, segment, tiles

KEY = ("t", "lat_i", "lon_i")
EDGES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def _grid(part, x: str, missing, shape: tuple[int, int]) -> np.ndarray:
    grid = np.full(shape, missing)
    grid[part["lat_i"].to_numpy(), part["lon_i"].to_numpy()] = part[x].fillna(missing).to_numpy()
    return grid


def _cells(part, grid: np.ndarray) -> np.ndarray:
    return grid[part["lat_i"].to_numpy(), part["lon_i"].to_numpy()]


def _shape(p: Profile) -> tuple[int, int]:
    return p.n_lat, p.n_lon


def _cross(a: np.ndarray, outside: bool) -> list[np.ndarray]:
    p = np.pad(a, 1, constant_values=outside)
    return [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]


def _opened(a: np.ndarray) -> np.ndarray:
    """Binary opening by a cross; what lies outside the grid changes nothing."""
    return np.logical_or.reduce(_cross(np.logical_and.reduce(_cross(a, True)), False))


def _distance(a: np.ndarray) -> np.ndarray:
    """Distance of each true cell to the nearest false one: first along columns, then the least over each row."""
    steps = np.full(a.shape, np.inf)
    for rows in (range(len(a)), reversed(range(len(a)))):
        run = np.full(a.shape[1], np.inf)
        for i in rows:
            run = np.where(a[i], run + 1, 0)
            steps[i] = np.minimum(steps[i], run)
    square, at = np.full(a.shape, np.inf), np.arange(a.shape[1])
    for j in at:
        square = np.minimum(square, steps[:, [j]] ** 2 + (at - j) ** 2)
    return np.sqrt(square)


def _labels(a: np.ndarray, diagonal: bool = False) -> np.ndarray:
    found = segment.flood(set(zip(*np.nonzero(a), strict=True)), diagonal)
    out = np.zeros(a.shape, dtype=int)
    for cell, n in found.items():
        out[cell] = n
    return out


def _flooded(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Watershed: markers spread over the mask from the lowest cell up; among equals the one reached first, then reading order."""
    out, age = np.where(mask, markers, 0), 0
    queue = [(height[i, j], 0, i, j) for i, j in zip(*np.nonzero(out), strict=True)]
    heapq.heapify(queue)
    while queue:
        _, _, i, j = heapq.heappop(queue)
        for di, dj in EDGES:
            y, x = i + di, j + dj
            if 0 <= y < out.shape[0] and 0 <= x < out.shape[1] and mask[y, x] and not out[y, x]:
                out[y, x] = out[i, j]
                age += 1
                heapq.heappush(queue, (height[y, x], age, y, x))
    return out


def outer_rim(back: np.ndarray, coherence: float) -> np.ndarray:
    """Cells of `back` that the watershed gives to no core: cores lie further than `coherence` times the greatest
    distance from the opened mask's edge; cells lost by the opening are a marker of their own, the rest is flooded."""
    opened = _opened(back)
    if opened.all():
        return np.zeros(back.shape, dtype=bool)  # no edge, so neither cores nor rim
    far = _distance(opened)
    core = far > coherence * far.max()
    markers = np.where(core, _labels(core) + 1, np.where(opened, 0, 1))
    return _flooded(-far, markers, back) == 1


def watershed(df: DataFrame, x: str, method: str = "otsu", coherence: float = 0.3, static: float | None = None, out: str = "rim", p: Profile = Profile()) -> DataFrame:
    """t, lat_i, lon_i, `out`: the rim of the background of each slot.

    Background: below the slot's Otsu threshold (otsu), below or above a given one (static, static-inverted), or zero (binary).
    Missing values are no background; constant slots have none by Otsu.
    """
    if method == "otsu":
        df = df.join(segment.otsu(df, x, ["t"]), "t", "left")
        back = F.col(x) < F.col("threshold")
    elif method in ("static", "static-inverted", "binary"):
        back = F.col(x) == 0 if method == "binary" else F.col(x) < static if method == "static" else F.col(x) > static
    else:
        raise ValueError(f"unknown method {method}")

    def run(part):
        return part[list(KEY)].assign(**{out: _cells(part, outer_rim(_grid(part, "_back", False, _shape(p)), coherence))})

    return df.select(*KEY, F.coalesce(back, F.lit(False)).alias("_back")).groupBy("t").applyInPandas(run, f"t int, lat_i int, lon_i int, {out} boolean")


def region_mean(df: DataFrame, flag: str, x: str, out: str) -> DataFrame:
    """Adds `out`: the mean of x over the cell's 8-connected region of true cells (0 elsewhere, and where x is missing
    throughout), then the greatest of the 3x3 box."""
    found = tiles.regions(df, flag, diagonal=True)
    means = found.join(df.select(*KEY, x), list(KEY)).groupBy("first").agg(F.avg(x).alias(out))
    df = df.join(found.join(means, "first").select(*KEY, out), list(KEY), "left")
    return neighbourhood.local_max(df.withColumn(out, F.coalesce(out, F.lit(0.0))), out, out)


def _box(a: np.ndarray, f) -> np.ndarray:
    for axis in (0, 1):
        p = np.pad(a, [(1, 1) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        a = f(f(np.take(p, range(a.shape[axis]), axis), a), np.take(p, range(2, a.shape[axis] + 2), axis))
    return a


def _means(seeds: np.ndarray, x: np.ndarray) -> np.ndarray:
    labels, valid = _labels(seeds, True), ~np.isnan(x)
    n = labels.max() + 1
    count = np.bincount(labels[valid], minlength=n)
    mean = np.divide(np.bincount(labels[valid], x[valid], n), count, out=np.zeros(n), where=count > 0)
    mean[0] = 0
    return _box(mean[labels], np.maximum)


def grown(seeds: np.ndarray, vis: np.ndarray, lir: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Seeds that fill a 3x3 box, grown over allowed border cells like their region until nothing is added:
    brighter than 1.05 times its mean, and from 5 below its mean temperature to 0.5 above."""
    seeds = _box(seeds, np.logical_and)
    while True:
        border = _box(seeds, np.logical_or) & ~seeds
        warm, bright = _means(seeds, lir), _means(seeds, vis)
        new = border & allowed & (lir > warm - 5.0) & (lir < warm + 0.5) & (vis > 1.05 * bright)
        if not new.any():
            return seeds
        seeds = seeds | new


def grow(df: DataFrame, seeds: str, vis: str, lir: str, allowed: str, out: str = "grown", p: Profile = Profile()) -> DataFrame:
    """t, lat_i, lon_i, `out`: the seeds of each slot, grown; missing values never join, missing flags are false."""

    def run(part):
        flags = [_grid(part, c, False, _shape(p)) for c in ("_seed", "_may")]
        values = [_grid(part, c, np.nan, _shape(p)) for c in ("_vis", "_lir")]
        return part[list(KEY)].assign(**{out: _cells(part, grown(flags[0], *values, flags[1]))})

    no = F.lit(False)
    df = df.select(*KEY, F.coalesce(seeds, no).alias("_seed"), F.coalesce(allowed, no).alias("_may"), F.col(vis).cast("double").alias("_vis"), F.col(lir).cast("double").alias("_lir"))
    return df.groupBy("t").applyInPandas(run, f"t int, lat_i int, lon_i int, {out} boolean")


def disk_thresholds(gray: np.ndarray, radius: int) -> np.ndarray:
    """Otsu threshold of the disk around each cell, over its gray values as they are; NaN where they are constant."""
    span = range(-radius, radius + 1)
    inside = [(y, x) for y in span for x in span if y * y + x * x <= radius * radius]
    padded, (h, w) = np.pad(gray, radius, constant_values=np.nan), gray.shape
    out = np.full(gray.shape, np.nan)
    for i in range(h):  # a row at a time bounds memory
        box = np.sort(np.stack([padded[i + radius + y, radius + x : radius + x + w] for y, x in inside]), axis=0)
        n, ahead = (~np.isnan(box)).sum(axis=0), np.nancumsum(box, axis=0)
        k = np.arange(1, len(inside))[:, None]
        split = (k < n) & (box[:-1] < box[1:])
        with np.errstate(divide="ignore", invalid="ignore"):
            between = np.round(k * (n - k) * (ahead[:-1] / k - (ahead[-1] - ahead[:-1]) / (n - k)) ** 2, 3)
        between = np.where(split, between, -1.0)
        best = between.argmax(axis=0)
        out[i] = np.where(split.any(axis=0), box[best, np.arange(w)], np.nan)
    return out


def local_otsu(df: DataFrame, gray: str, radius: int = 5, out: str = "above", size: tuple[int, int, int] = tiles.SIZE) -> DataFrame:
    """t, lat_i, lon_i, `out`: the gray value lies above the Otsu threshold of the disk around it; false where missing or constant."""
    return tiles.disk_otsu(df, gray, lambda grid: disk_thresholds(grid, radius), radius, out, size)
