"""Density clusters (DBSCAN) over a grid of cells.

Cells have the side eps / sqrt(dimensions), so that all points of a cell lie
within eps of one another: a cell of `least` points holds core points only, and
a cell's core points are one cluster.  Distances are taken only for points of
cells with fewer points, against the cells around them, so their number grows
with the points, not with the square of a crowd.  Whether two neighbouring
cells are linked is told by boxes around their core points, which are halved
until they are apart, together, or points.  Linked cells are the edges of a
graph, whose components are the clusters.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from . import graph


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _squared(left: list[Column], right: list[Column]) -> Column:
    return _sum((a - b) * (a - b) for a, b in zip(left, right, strict=True))


def _around(dimensions: int) -> list[tuple[int, ...]]:
    """Steps to the cells that can hold a point within eps, but for the cell itself."""
    reach = math.ceil(math.sqrt(dimensions))
    near = lambda s: sum(max(0, abs(d) - 1) ** 2 for d in s) <= dimensions  # noqa: E731  (in squared sides; eps is sqrt(dimensions) of them)
    return [s for s in itertools.product(range(-reach, reach + 1), repeat=dimensions) if any(s) and near(s)]


def _linked(core: DataFrame, cells: list[str], xs: list[str], eps: float) -> DataFrame:
    """a, b: numbers of the neighbouring cells with core points within eps of each other."""
    names = cut(core.groupBy(*cells).agg(F.min("id").alias("cell")))
    core = cut(core.join(names, cells).select("cell", *cells, *xs))
    half = [s for s in _around(len(xs)) if s > tuple([0] * len(xs))]
    steps = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in half)))
    ahead = names.select(F.col("cell").alias("a"), *cells, steps.alias("s")).select("a", *((F.col(c) + F.col("s")[i]).alias(c) for i, c in enumerate(cells)))
    pairs = cut(ahead.join(names.withColumnRenamed("cell", "b"), cells).select("a", "b", F.lit("").alias("pa"), F.lit("").alias("pb")))
    parts, found = core.select("cell", *cells, F.lit("").alias("path"), *xs), []
    side, depth = eps / math.sqrt(len(xs)), 0
    while not pairs.isEmpty():
        boxes = cut(parts.groupBy("cell", "path").agg(*(f(x).alias(f"{k}_{x}") for x in xs for k, f in (("lo", F.min), ("hi", F.max)))))
        for end, path in (("a", "pa"), ("b", "pb")):
            pairs = pairs.join(boxes.select(F.col("cell").alias(end), F.col("path").alias(path), *(F.col(f"{k}_{x}").alias(f"{end}{k}_{x}") for x in xs for k in ("lo", "hi"))), [end, path])
        lo, hi = ({e: [F.col(f"{e}{k}_{x}") for x in xs] for e in "ab"} for k in ("lo", "hi"))
        gap = [F.greatest(lo["a"][i] - hi["b"][i], lo["b"][i] - hi["a"][i], F.lit(0.0)) for i in range(len(xs))]
        span = [F.greatest(hi["a"][i] - lo["b"][i], hi["b"][i] - lo["a"][i]) for i in range(len(xs))]
        judged = cut(pairs.select("a", "b", "pa", "pb", (_sum(g * g for g in gap) <= eps * eps).alias("near"), (_sum(s * s for s in span) <= eps * eps).alias("within")))
        sure = cut(judged.filter("within").select("a", "b").distinct())
        found.append(sure)
        open_ = judged.filter("near").join(sure, ["a", "b"], "left_anti").select("a", "b", "pa", "pb")
        # halve the boxes: a point's path grows by its side of every middle
        depth += 1
        part = [F.when(F.floor((F.col(x) - F.col(c) * side) / side * 2**depth) % 2 == 0, "0").otherwise("1") for x, c in zip(xs, cells, strict=True)]
        longer = cut(parts.withColumn("path", F.concat("path", F.lit("."), *part)))
        paths = longer.select("cell", "path").distinct()
        above = F.substring_index("path", ".", depth)
        for end, path in (("a", "pa"), ("b", "pb")):
            open_ = open_.join(paths.select(F.col("cell").alias(end), above.alias(path), F.col("path").alias(f"n{path}")), [end, path]).drop(path).withColumnRenamed(f"n{path}", path)
        pairs, parts = cut(open_.select("a", "b", "pa", "pb")), longer
    out = core.select(F.col("cell").alias("a"), F.col("cell").alias("b")).distinct()
    return reduce(DataFrame.union, found, out)


def clusters(points: DataFrame, key: str, xs: list[str], eps: float, least: int) -> DataFrame:
    """`key`, is_core, cluster of every point (unique `key`, an integer).

    A core point has `least` points within eps, itself included; a cluster is
    named by its least core point; another point within eps of core points
    belongs to the least of their clusters; the rest has none.  Points with a
    missing coordinate are no neighbours and have none.
    """
    side = eps / math.sqrt(len(xs))
    cells = [f"_c{i}" for i in range(len(xs))]
    rows = points.select(F.col(key).alias("id"), *(F.col(x).cast("double").alias(x) for x in xs))
    there = reduce(lambda a, b: a & b, (F.col(x).isNotNull() for x in xs))
    placed = cut(rows.filter(there).select("id", *xs, *(F.floor(F.col(x) / side).alias(c) for x, c in zip(xs, cells, strict=True))))
    counts = cut(placed.groupBy(*cells).agg(F.count("*").alias("crowd")))
    placed = cut(placed.join(counts, cells))
    few = placed.filter(F.col("crowd") < least)
    steps = F.explode(F.array(*(F.array(*map(F.lit, s)) for s in _around(len(xs)))))
    looking = few.select("id", "crowd", *(F.col(x).alias(f"q_{x}") for x in xs), *cells, steps.alias("s")).select("id", "crowd", *(f"q_{x}" for x in xs), *((F.col(c) + F.col("s")[i]).alias(c) for i, c in enumerate(cells)))
    looking = cut(looking)
    within = _squared([F.col(f"q_{x}") for x in xs], [F.col(x) for x in xs]) <= eps * eps
    near = looking.join(placed.drop("id", "crowd"), cells).filter(within).groupBy("id").agg(F.count("*").alias("near"))
    own = few.select("id", "crowd").join(near, "id", "left")
    core_few = own.filter(F.col("crowd") + F.coalesce("near", F.lit(0)) >= least).select("id")
    core = cut(placed.filter(F.col("crowd") >= least).select("id", *cells, *xs).unionByName(few.select("id", *cells, *xs).join(core_few, "id", "left_semi")))
    links = cut(_linked(core, cells, xs, eps))
    joined = graph.components(links)
    firsts = core.groupBy(*cells).agg(F.min("id").alias("cell"))
    named = firsts.join(joined, F.col("node") == F.col("cell"), "left").select(*cells, F.coalesce("comp", "cell").alias("cluster"))
    core = cut(core.join(named, cells))
    # the others take the least cluster of a core point within eps: of their own cell, or around it
    edge = cut(looking.join(core.select("id"), "id", "left_anti"))
    around = edge.join(core.drop("id"), cells).filter(within).select("id", "cluster")
    inside = few.join(core.select("id"), "id", "left_anti").select("id", *cells).join(named, cells).select("id", "cluster")
    border = around.union(inside).groupBy("id").agg(F.min("cluster").alias("cluster"))
    known = core.select("id", F.lit(True).alias("is_core"), "cluster").union(border.select("id", F.lit(False), "cluster"))
    out = rows.select("id").join(known, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("is_core", F.lit(False)).alias("is_core"), "cluster")
