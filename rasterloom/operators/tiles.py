"""Neighbourhoods, regions and watersheds over tiles with a halo.

A cube (t, lat_i, lon_i) is cut into tiles of `size` slots, rows and columns.
Every cell goes to its own tile and to those whose halo it lies in, so a task
holds one tile and its halo, whatever the size of a slot or of the cube, and
what it returns about its own cells is the same for any size of tile.

Missing values are NaN in a tile, missing flags false; cells that the cube
lacks are outside: false, NaN or the fill given.  Columns other than the named
ones are ignored.  Empty cubes give no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Profile
from ..sources.storage import cut
from . import graph

KEY = ("t", "lat_i", "lon_i")
SIZE = (16, 64, 64)
ROW = 1 << 20  # more than a slot has rows or columns
FACES = ((1, 0, 0), (0, 1, 0), (0, 0, 1))


@dataclass
class Tile:
    """Arrays of a tile and its halo, and where they lie in the cube."""

    grids: dict[str, np.ndarray]
    inside: np.ndarray  # cells that the cube has
    origin: np.ndarray  # of the arrays, in the cube
    halo: tuple[int, int, int]

    def mirrored(self, name: str, extent: tuple[int, int, int]) -> np.ndarray:
        """The array with what lies outside the extent mirrored into it, the edge cell first."""
        out = self.grids[name]
        for axis, n in enumerate(extent):
            at = self.origin[axis] + np.arange(out.shape[axis])
            at = np.where(at < 0, -at - 1, np.where(at >= n, 2 * n - 1 - at, at)) - self.origin[axis]
            out = np.take(out, np.clip(at, 0, out.shape[axis] - 1), axis)
        return out

    def core(self, array: np.ndarray) -> np.ndarray:
        return array[tuple(slice(h, n - h) for h, n in zip(self.halo, array.shape, strict=True))]


def over_tiles(
    df: DataFrame, columns: dict[str, object], f: Callable[[Tile], dict[str, np.ndarray]], out: str, size: tuple[int, int, int] = SIZE, halo: tuple[int, int, int] = (0, 0, 0)
) -> DataFrame:
    """t, lat_i, lon_i and the columns `out` (a DDL string) that `f` returns as arrays of the tile without its halo.

    `columns` names the columns that `f` reads and what stands for missing ones.
    """
    dealt = df.select(*KEY, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in columns.items()))
    for axis, (x, s, h) in enumerate(zip(KEY, size, halo, strict=True)):
        first, last = (F.floor((F.col(x) + d) / s).cast("int") for d in (-h, h))
        dealt = dealt.withColumn(f"_tile{axis}", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)) if h else first)
    names = [x.split()[0] for x in out.split(", ")]
    tile_key = ["_tile0", "_tile1", "_tile2"]
    steps, border = np.array(size), np.array(halo)

    def run(part):
        own = part[tile_key].iloc[0].to_numpy() * steps
        origin = own - border
        at = tuple((part[list(KEY)].to_numpy() - origin).T)
        shape = tuple(steps + 2 * border)
        inside = np.zeros(shape, bool)
        inside[at] = True
        grids = {}
        for c, missing in columns.items():
            grids[c] = np.full(shape, missing)
            grids[c][at] = part[c].to_numpy()
        mine = part[((part[list(KEY)].to_numpy() >= own) & (part[list(KEY)].to_numpy() < own + steps)).all(axis=1)]
        result = mine[list(KEY)].copy()
        if len(mine):
            made = f(Tile(grids, inside, origin, halo))
            where = tuple((mine[list(KEY)].to_numpy() - own).T)
            for c in names:
                values = made[c][where]
                result[c] = list(values) if values.ndim > 1 else values
        else:
            result = result.assign(**{c: result["t"].astype(object) for c in names})
        return result

    return dealt.groupBy(*tile_key).applyInPandas(run, f"t int, lat_i int, lon_i int, {out}")


# neighbourhoods in a slot


def _windows(a: np.ndarray, scope: int) -> np.ndarray:
    """The scope x scope box around each cell of a slot, as a last axis."""
    boxes = np.lib.stride_tricks.sliding_window_view(a, (scope, scope), axis=(1, 2))
    return boxes.reshape(*boxes.shape[:3], -1)


def _dilated(flag: np.ndarray) -> np.ndarray:
    """Dilation by a cross within a slot, one cell smaller on each side."""
    return flag[:, 1:-1, 1:-1] | flag[:, :-2, 1:-1] | flag[:, 2:, 1:-1] | flag[:, 1:-1, :-2] | flag[:, 1:-1, 2:]


def _boxed(df: DataFrame, x: str, out: str, scope: int, mask: str | None, p: Profile, size, reduce) -> DataFrame:
    if scope % 2 == 0 or scope < 1:
        raise ValueError("a box around a cell has an odd number of rows")
    reach = max(scope // 2, 1)
    flags = {mask: False} if mask else {}

    def f(tile: Tile) -> dict[str, np.ndarray]:
        a = tile.mirrored(x, (1 << 30, p.n_lat, p.n_lon))
        spare = reach - scope // 2
        values = reduce(_windows(a[:, spare : a.shape[1] - spare, spare : a.shape[2] - spare], scope))
        if mask:
            wide = tile.grids[mask] & tile.inside
            edge = reach - 1
            values = np.where(_dilated(wide[:, edge : wide.shape[1] - edge, edge : wide.shape[2] - edge]), -10.0, values)
        return {out: values}

    found = over_tiles(df.withColumn(x, F.col(x).cast("double")), {x: np.nan, **flags}, f, f"{out} double", size, (0, reach, reach))
    return df.join(found, list(KEY))


def local_std(df: DataFrame, x: str, out: str, scope: int = 3, mask: str | None = None, p: Profile = Profile(), size: tuple[int, int, int] = SIZE) -> DataFrame:
    """Adds `out`: population standard deviation in the scope x scope box of each slot, edges mirrored; -10 where the mask, dilated by a cross, holds."""
    return _boxed(df, x, out, scope, mask, p, size, lambda w: np.sqrt(w.var(axis=-1)))


def local_max(df: DataFrame, x: str, out: str, scope: int = 3, mask: str | None = None, p: Profile = Profile(), size: tuple[int, int, int] = SIZE) -> DataFrame:
    """Adds `out`: the greatest value of the box, as local_std."""
    return _boxed(df, x, out, scope, mask, p, size, lambda w: w.max(axis=-1))


def patches(df: DataFrame, x: str, out: str, shape: tuple[int, int, int], size: tuple[int, int, int] = SIZE) -> DataFrame:
    """t, lat_i, lon_i, `out`: the values of the box of `shape` (odd slots, rows, columns) around each cell, in order; -1 outside the cube and where missing."""
    if any(n % 2 == 0 or n < 1 for n in shape):
        raise ValueError("a patch has an odd number of slots, rows and columns")

    def f(tile: Tile) -> dict[str, np.ndarray]:
        boxes = np.lib.stride_tricks.sliding_window_view(tile.grids[x], shape)
        return {out: boxes.reshape(*boxes.shape[:3], -1)}

    return over_tiles(df.withColumn(x, F.col(x).cast("double")), {x: -1.0}, f, f"{out} array<double>", size, tuple(n // 2 for n in shape))


def disk_otsu(df: DataFrame, gray: str, thresholds: Callable[[np.ndarray], np.ndarray], radius: int, out: str, size: tuple[int, int, int] = SIZE) -> DataFrame:
    """t, lat_i, lon_i, `out`: the value lies above the threshold that `thresholds` gives for its slot's tile and halo; false where missing."""

    def f(tile: Tile) -> dict[str, np.ndarray]:
        limits = np.stack([thresholds(g) for g in tile.grids[gray]])
        with np.errstate(invalid="ignore"):
            return {out: tile.core(tile.grids[gray] > limits)}

    return over_tiles(df.withColumn(gray, F.col(gray).cast("double")), {gray: np.nan}, f, f"{out} boolean", size, (0, radius, radius))


# regions


def _offsets(over_time: bool, diagonal: bool) -> list[tuple[int, int, int]]:
    """One of each pair of opposite neighbours."""
    steps = [(a, b, c) for a in (0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0) and (over_time or a == 0)]
    return steps if diagonal else [s for s in steps if sum(map(abs, s)) == 1]


def _shifted(a: np.ndarray, step: tuple[int, int, int], fill) -> np.ndarray:
    """What lies `step` further on."""
    out = np.full_like(a, fill)
    to = tuple(slice(max(0, -d), a.shape[i] - max(0, d)) for i, d in enumerate(step))
    back = tuple(slice(max(0, d), a.shape[i] - max(0, -d)) for i, d in enumerate(step))
    out[to] = a[back]
    return out


def _least_in_region(flag: np.ndarray, number: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """The least number of each cell's region: numbers spread over neighbours, and jump to what their holder has found, until they stay."""
    none = np.iinfo(np.int64).max
    flat = np.arange(flag.size).reshape(flag.shape)
    root = np.where(flag, flat, flag.size)
    while True:
        least = root
        for step in steps:
            for s in (step, tuple(-d for d in step)):
                least = np.where(flag, np.minimum(least, _shifted(root, s, flag.size)), flag.size)
        table = np.append(least.ravel(), flag.size)
        while True:
            further = table[table]
            if (further == table).all():
                break
            table = further
        new = table[:-1].reshape(flag.shape)
        if (new == root).all():
            return np.where(flag, np.append(number.ravel(), none)[root], none)
        root = new


def regions(
    df: DataFrame, flag: str, over_time: bool = False, diagonal: bool = False, size: tuple[int, int, int] = SIZE
) -> DataFrame:
    """t, lat_i, lon_i, first: of each true cell, the number of its region's first cell, (t * ROW + lat_i) * ROW + lon_i.

    Regions are connected by faces (`diagonal`: also by edges and corners)
    within a slot or, `over_time`, through the volume.  Tiles label what is
    connected in them; labels that touch across tiles are edges of a graph,
    whose components rename them.
    """
    steps = _offsets(over_time, diagonal)

    def f(tile: Tile) -> dict[str, np.ndarray]:
        a = tile.grids[flag]
        at = np.indices(a.shape) + tile.origin[:, None, None, None]
        return {"label": _least_in_region(a, (at[0] * ROW + at[1]) * ROW + at[2], steps)}

    cells = df.filter(F.col(flag))
    found = cut(over_tiles(cells, {flag: False}, f, "label long", size))
    # cells with a neighbour in another tile
    tile = [F.floor(F.col(x) / s) for x, s in zip(KEY, size, strict=True)]

    def neighbour(step, sign: int) -> list[Column]:
        return [F.col(x) + sign * d for x, d in zip(KEY, step, strict=True)]

    links = None
    for step in steps:
        crosses = [sum(F.when(F.floor(n / s) != own, 1).otherwise(0) for n, s, own in zip(neighbour(step, sign), size, tile, strict=True)) > 0 for sign in (1, -1)]
        here = found.filter(crosses[0]).select(*(n.alias(x) for n, x in zip(neighbour(step, 1), KEY, strict=True)), F.col("label").alias("a"))
        there = found.filter(crosses[1]).select(*KEY, F.col("label").alias("b"))
        pairs = here.join(there, list(KEY)).select("a", "b").distinct()
        links = pairs if links is None else links.union(pairs)
    names = graph.components(links)
    return found.join(names.select(F.col("node").alias("label"), "comp"), "label", "left").select(*KEY, F.coalesce("comp", "label").alias("first"))


def numbered(found: DataFrame) -> DataFrame:
    """t, lat_i, lon_i, region: the regions of each slot counted from 1, in the order of their first cells."""
    each = found.select("t", "first").distinct()
    each = each.withColumn("region", F.row_number().over(Window.partitionBy("t").orderBy("first")))
    return found.join(each, ["t", "first"]).select(*KEY, "region")


# watershed over the volume


def opened(df: DataFrame, flag: str, out: str, size: tuple[int, int, int] = SIZE) -> DataFrame:
    """t, lat_i, lon_i, `out`: the flag opened by an octahedron of six neighbours; what lies outside the cube changes nothing."""

    def cross(a: np.ndarray, fill: bool) -> list[np.ndarray]:
        return [a, *(_shifted(a, tuple(s * d for d in step), fill) for step in FACES for s in (1, -1))]

    def f(tile: Tile) -> dict[str, np.ndarray]:
        eroded = np.logical_and.reduce(cross(tile.grids[flag] | ~tile.inside, True)) & tile.inside
        return {out: tile.core(np.logical_or.reduce(cross(eroded, False)))}

    return over_tiles(df, {flag: False}, f, f"{out} boolean", size, (2, 2, 2))


def _least_on_line(axis: str):
    def run(part):
        x, d = part[axis].to_numpy(), part["_d"].fillna(np.inf).to_numpy()
        least = np.full(len(x), np.inf)
        for i in range(len(x)):
            np.minimum(least, d[i] + (x - x[i]) ** 2, out=least)
        return part.assign(_d=np.where(np.isinf(least), np.nan, least))

    return run


def squared_distance(df: DataFrame, flag: str, out: str) -> DataFrame:
    """t, lat_i, lon_i, `out`: squared distance of each cell to the nearest false one, null where there is none.

    Exact, one axis at a time: along time by two windows, then the least of the
    line's squares plus squared steps along latitude and longitude; no group is
    larger than a line.
    """
    by_time = Window.partitionBy("lat_i", "lon_i").orderBy("t")
    off = F.when(~F.col(flag), F.col("t"))
    before = F.last(off, True).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(off, True).over(by_time.rowsBetween(0, Window.unboundedFollowing))
    steps = F.least(F.col("t") - before, after - F.col("t"))
    lines = df.select(*KEY, (steps * steps).cast("double").alias("_d"))
    for axis, by in (("lat_i", ("t", "lon_i")), ("lon_i", ("t", "lat_i"))):
        lines = lines.groupBy(*by).applyInPandas(_least_on_line(axis), "t int, lat_i int, lon_i int, _d double")
    return lines.select(*KEY, F.when(~F.isnan("_d"), F.col("_d")).alias(out))


def _neighbours(a: np.ndarray):
    for step in FACES:
        for s in (1, -1):
            yield _shifted(a, tuple(s * d for d in step), np.inf)


def _passes(mask: np.ndarray, height: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The least height over which a cell is reached through the mask, as far as the array knows."""
    while True:
        new = best
        for other in _neighbours(best):
            new = np.where(mask, np.minimum(new, np.maximum(other, height)), new)
        if (new == best).all():
            return new
        best = new


def _ways(mask: np.ndarray, height: np.ndarray, over: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Twice the steps of the shortest way of least height, plus the kind (0 or 1) of the marker that it comes from."""
    before = [mask & (np.maximum(other, height) == over) for other in _neighbours(over)]
    while True:
        new = best
        for other, may in zip(_neighbours(best), before, strict=True):
            new = np.where(may, np.minimum(new, other + 2), new)
        if (new == best).all():
            return new
        best = new


def _settled(state: DataFrame, columns: dict[str, object], changes: str, relax: Callable[..., np.ndarray], size: tuple[int, int, int]) -> DataFrame:
    """Tiles relaxed one beside the other, and with their neighbours' results again, until nothing changes."""

    def f(tile: Tile) -> dict[str, np.ndarray]:
        new = relax(*(tile.grids[c] for c in columns if c != changes), tile.grids[changes])
        out = {c: tile.core(g) for c, g in tile.grids.items()}
        return {**out, changes: tile.core(new), "moved": tile.core(new != tile.grids[changes])}

    kinds = ", ".join(f"{c} {'boolean' if missing is False else 'double'}" for c, missing in columns.items())
    while True:
        step = cut(over_tiles(state, columns, f, f"{kinds}, moved boolean", size, (1, 1, 1)))
        state = step.drop("moved")
        if step.filter("moved").isEmpty():
            return state


def watershed_volume(df: DataFrame, back: str, coherence: float = 0.3, out: str = "rim", size: tuple[int, int, int] = SIZE) -> DataFrame:
    """t, lat_i, lon_i, `out`: the rim of the background `back`: cells that flooding gives to what the opening lost, not to a core.

    Cores lie further than `coherence` times the greatest distance from the
    edge of the opened background.  The rest of the background floods from its
    deepest cells up: each cell is reached over the least height there is, by
    the shortest of the ways that are lowest up to every cell on them, from the
    rim if that and a core are as near.  Both are the one least solution of
    their equations, so tiles are relaxed beside one another and meet by their
    halos until nothing changes, with the same result for any size.  A
    background that has no edge, or is empty, has no rim.
    """
    cells = cut(df.select(*KEY, F.coalesce(back, F.lit(False)).alias("back")))
    cells = cut(cells.join(opened(cells, "back", "open", size), list(KEY)))
    cells = cut(cells.join(squared_distance(cells, "open", "square"), list(KEY)))
    top = cells.filter("open").agg(F.max("square")).first()[0]
    if top is None:  # the opening left nothing, or everything
        whole = cells.filter("not open").isEmpty()
        return cells.select(*KEY, (F.col("back") & F.lit(not whole)).alias(out))
    far, infinite = F.sqrt("square"), F.lit(float("inf"))
    core = F.col("open") & (far > coherence * float(top) ** 0.5)
    marker = F.col("back") & (core | ~F.col("open"))
    state = cells.select(*KEY, "back", (-far).alias("height"), F.when(marker, -far).otherwise(infinite).alias("over"), F.when(marker, core.cast("double")).otherwise(infinite).alias("way"))
    state = _settled(state, {"back": False, "height": np.inf, "over": np.inf, "way": np.inf}, "over", lambda back, height, _, over: _passes(back, height, over), size)
    state = _settled(state, {"back": False, "height": np.inf, "over": np.inf, "way": np.inf}, "way", _ways, size)
    return state.select(*KEY, (F.col("back") & (F.col("way") % 2 == 0)).alias(out))
