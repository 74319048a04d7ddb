"""Segmentation: Otsu thresholds, histogram equalisation, connected regions, frequency filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def otsu(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """`by`..., threshold: the centre of the bin that maximises the variance between the two sides (first among equals).

    A group's histogram has at most 256 rows, whatever its size.  Constant
    groups have a null threshold.
    """
    ok = df.filter(F.col(x).isNotNull())
    span = ok.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / BINS
    bin_ = F.least(F.floor((F.col(x) - F.col("lo")) / width), F.lit(BINS - 1)).cast("int")
    hist = ok.join(span, by).filter("hi > lo").groupBy(*by, bin_.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    hist = hist.withColumn("c", centre)
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    hist = hist.select(*by, "bin", "c", F.sum("n").over(upto).alias("w1"), F.sum(F.col("n") * F.col("c")).over(upto).alias("s1"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("c")).over(whole).alias("s"))
    w2 = F.col("w") - F.col("w1")
    between = F.round(F.col("w1") * w2 * F.pow(F.try_divide(F.col("s1"), F.col("w1")) - F.try_divide(F.col("s") - F.col("s1"), w2), 2), 3)
    best = hist.filter("w > w1").groupBy(*by).agg(F.max(F.struct(between.alias("v"), (-F.col("bin")).alias("b"), "c")).alias("top"))
    return span.join(best, by, "left").select(*by, F.col("top.c").alias("threshold"))


def segmentation(df: DataFrame, x: str, method: str, static: float | None = None, out: str = "above") -> DataFrame:
    """Adds `out`: x above the threshold of its slot (otsu-2d), of all (otsu-3d), or above a given one (static); missing and constant: false."""
    if method == "static":
        return df.withColumn(out, F.coalesce(F.col(x) > static, F.lit(False)))
    if method == "otsu-2d":
        limits = otsu(df, x, ["t"])
        return df.join(limits, "t", "left").withColumn(out, F.coalesce(F.col(x) > F.col("threshold"), F.lit(False))).drop("threshold")
    if method == "otsu-3d":
        limits = F.broadcast(otsu(df.withColumn("_all", F.lit(1)), x, ["_all"]).select("threshold"))  # a single row
        return df.join(limits, how="left").withColumn(out, F.coalesce(F.col(x) > F.col("threshold"), F.lit(False))).drop("threshold")
    raise ValueError(f"unknown method {method}")


def equalize(df: DataFrame, x: str, by: list[str], out: str = "equal") -> DataFrame:
    """8-bit histogram equalisation of an integer column (0..255) within each group."""
    ok = df.filter(F.col(x).isNotNull())
    hist = ok.groupBy(*by, x).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    cdf = hist.withColumn("cdf", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole)).withColumn("low", F.min("cdf").over(whole))
    value = F.coalesce(F.floor(F.try_divide(255.0 * (F.col("cdf") - F.col("low")), F.col("all") - F.col("low")) + 0.5), F.lit(0)).cast("int")
    return ok.join(cdf.select(*by, x, value.alias(out)), [*by, x])


def flood(flags, diagonal: bool = False):
    """Labels of 4-connected (8-connected: `diagonal`) true cells of one grid, by flood fill."""
    labels, n = {}, 0
    steps = [(a, b) for a in (1, 0, -1) for b in (1, 0, -1) if (a or b) and (diagonal or not (a and b))]
    for start in sorted(flags):
        if start in labels:
            continue
        n += 1
        stack = [start]
        while stack:
            i, j = stack.pop()
            if (i, j) in flags and (i, j) not in labels:
                labels[i, j] = n
                stack += [(i + a, j + b) for a, b in steps]
    return labels


def regions(df: DataFrame, flag: str, diagonal: bool = False) -> DataFrame:
    """t, lat_i, lon_i, region: 4-connected (8-connected: `diagonal`) regions of true cells, numbered in each slot from 1.

    One slot's grid at a time in a task; its size is the grid's.
    """

    def run(part):
        labels = flood(set(zip(part["lat_i"], part["lon_i"], strict=True)), diagonal)
        return part[["t", "lat_i", "lon_i"]].assign(region=[labels[x] for x in zip(part["lat_i"], part["lon_i"], strict=True)])

    return df.filter(F.col(flag)).select("t", "lat_i", "lon_i").groupBy("t").applyInPandas(run, "t int, lat_i int, lon_i int, region int")
