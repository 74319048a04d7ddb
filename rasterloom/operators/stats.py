"""Aggregates: normalisation, correlation, class statistics, comparison of tests, midnight and sunrise slots, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ("lat_i", "lon_i")


def normalize_all(df: DataFrame, x: str, kinds: dict[str, str]) -> DataFrame:
    """Whole-cube normalisations {column: kind}: one row of statistics (partial aggregates), joined back once.

    kinds: max, centered, reduced, standard, gray-scale.
    """
    c = F.col(x)
    stats = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.max(F.abs(x)).alias("_top"), F.avg(x).alias("_mean"), F.stddev_pop(x).alias("_sd"))
    value = {
        "max": F.try_divide(c, F.col("_top")),
        "centered": c - F.col("_mean"),
        "reduced": F.try_divide(c, F.col("_sd")),
        "standard": F.try_divide(c - F.col("_mean"), F.col("_sd")),
        "gray-scale": F.coalesce(F.floor(F.try_divide(255 * (c - F.col("_lo")), F.col("_hi") - F.col("_lo"))).cast("int"), F.lit(0)),
    }
    one = F.broadcast(stats)  # a single row
    return df.join(one).withColumns({out: value[kind] for out, kind in kinds.items()}).drop("_lo", "_hi", "_top", "_mean", "_sd")


def normalize(df: DataFrame, x: str, kind: str, out: str = "norm") -> DataFrame:
    return normalize_all(df, x, {out: kind})


def gray_scaled(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds gray-scale columns {out: x} over the whole cube (0 where missing or constant), all bounds from one aggregate."""
    bounds = df.agg(*(f(x).alias(f"_{k}_{out}") for out, x in columns.items() for k, f in (("lo", F.min), ("hi", F.max))))
    gray = {out: F.floor(F.try_divide(255 * (F.col(x) - F.col(f"_lo_{out}")), F.col(f"_hi_{out}") - F.col(f"_lo_{out}"))).cast("int") for out, x in columns.items()}
    df = df.join(F.broadcast(bounds)).withColumns({out: F.coalesce(g, F.lit(0)) for out, g in gray.items()})  # a single row
    return df.drop(*(f"_{k}_{out}" for out in columns for k in ("lo", "hi")))


def pixel_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """lat_i, lon_i, n, mean_a, mean_b, r over slots in which both are valid; r null if either is constant."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    sums = both.groupBy(*CELL).agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"), F.covar_pop(a, b).alias("cov"))
    return sums.withColumn("r", F.when((F.col("sa") > 1e-9) & (F.col("sb") > 1e-9), F.try_divide(F.col("cov"), F.col("sa") * F.col("sb")))).drop("sa", "sb", "cov")


def class_statistics(classes: DataFrame, least_share: float = 1e-5) -> DataFrame:
    """t, cls, share of the whole cube; classes that never reach `least_share` are left out."""
    counts = classes.groupBy("t", "cls").agg(F.count("*").alias("n"))
    total = F.broadcast(classes.agg(F.count("*").alias("total")))  # a single row
    shares = counts.join(total).select("t", "cls", (F.col("n") / F.col("total")).alias("share"))
    used = shares.groupBy("cls").agg(F.max("share").alias("top")).filter(F.col("top") > least_share).select("cls")
    return shares.join(used, "cls")


def medians(df: DataFrame, x: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull()).groupBy("t").agg(F.median(x).alias("median"), F.count("*").alias("n"))


def compare(cloudy_1: Column, cloudy_2: Column) -> Column:
    """+1 only the first is cloudy, -1 only the second, else 0."""
    return F.when(cloudy_1 & ~cloudy_2, 1).when(cloudy_2 & ~cloudy_1, -1).otherwise(0)


def compare_visible(vis: Column, cls: Column, limit: float = 0.35) -> Column:
    return F.when((vis > limit) & (cls == 0), -1).when((vis < limit) & ~cls.isin(0, 2, 4, 7, 12), 1).otherwise(0)


def _union(tests: list[str]) -> Column:
    return reduce(lambda a, b: a | b, map(F.col, tests))


def common_scores(df: DataFrame, tests: list[str]) -> DataFrame:
    """One row: each test's share of what any of them finds."""
    return df.agg(*(F.try_divide(F.count_if(F.col(x)), F.count_if(_union(tests))).alias(x) for x in tests))


def unique_scores(df: DataFrame, tests: list[str]) -> DataFrame:
    """One row: the share that exactly that test finds."""
    alone = {x: reduce(lambda a, b: a & b, [F.col(x)] + [~F.col(y) for y in tests if y != x]) for x in tests}
    return df.agg(*(F.try_divide(F.count_if(c), F.count_if(_union(tests))).alias(x) for x, c in alone.items()))


def darkest_slots(df: DataFrame, cosz: str = "cosz") -> DataFrame:
    """lat_i, lon_i, dfb, midnight, midday: first slots of the day with the least and the largest cosine."""
    by_day = df.groupBy(*CELL, "dfb")
    return by_day.agg(F.min(F.struct(F.col(cosz), "slot")).getField("slot").alias("midnight"), F.max(F.struct(F.col(cosz), -F.col("slot"))).alias("top")).select(*CELL, "dfb", "midnight", (-F.col("top").getField("col2")).cast("int").alias("midday"))


def sun_edges(df: DataFrame, cosz: str = "cosz") -> DataFrame:
    """lat_i, lon_i, sunrise, sunset: slots of the steepest rise and fall of the cosine (first ones)."""
    w = Window.partitionBy(*CELL).orderBy("t")
    step = df.withColumn("rise", F.round(F.lead(cosz).over(w) - F.col(cosz), 9)).filter("rise is not null")
    return step.groupBy(*CELL).agg(F.max(F.struct("rise", (-F.col("t")).alias("s"))).alias("up"), F.min(F.struct("rise", F.col("t").alias("s"))).alias("down")).select(*CELL, (-F.col("up.s")).cast("int").alias("sunrise"), F.col("down.s").cast("int").alias("sunset"))


def sun_weights(axis: DataFrame, cosz: str, near: int = 1000) -> DataFrame:
    """Adds w: the chance that a slot is accepted, if it is kept where U * top > top - cosz for a uniform U
    and the largest cosine `top` within `near` slots; few rows, one a slot."""
    top = F.max(cosz).over(Window.orderBy("t").rowsBetween(-near, near))
    return axis.withColumn("w", F.when(top > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(cosz) / top)), 6)).otherwise(0.0))


def stratified_slots(axis: DataFrame, weight: Column, rate: float, layers: int, n_slots: int) -> DataFrame:
    """t, layer of the slots picked: layers of equal length get their share of `rate * n_slots` by weight.

    Inside a layer slots are dealt by a fixed integer hash, so that a rerun
    picks the same ones.  Few rows: the time axis, not the cube.
    """
    layered = axis.select("t", F.floor(F.col("t") * layers / n_slots).cast("int").alias("layer"), weight.alias("w"))
    total = int(rate * n_slots)
    sums = layered.groupBy("layer").agg(F.round(F.sum("w"), 4).alias("w"), F.count("*").alias("size"))
    whole = F.broadcast(sums.agg(F.sum("w").alias("all_w")))  # a single row
    share = sums.join(whole).select("layer", "size", "w", F.floor(F.try_divide(total * F.col("w"), F.col("all_w")) + 1e-9).cast("int").alias("n"))
    rest = F.broadcast(share.agg(F.sum("n").alias("dealt"), F.max(F.struct("w", (-F.col("layer")).alias("l"))).alias("top")))  # a single row
    share = share.join(rest).select("layer", F.least("size", F.col("n") + F.when(F.col("layer") == -F.col("top.l"), total - F.col("dealt")).otherwise(0)).alias("n"))
    order = Window.partitionBy("layer").orderBy((F.col("t") * 7919) % 10007, "t")
    return layered.withColumn("rank", F.row_number().over(order)).join(share, "layer").filter(F.col("rank") <= F.col("n")).select("t", "layer")


def peak_lags(df: DataFrame, x: str, cosz: str, lags: int, days: int = 1, least: float = 0.9) -> DataFrame:
    """lag, n: in how many cells and spans of `days` x follows `cosz` best by so many slots (correlation over `least`; the shortest of equals)."""
    span = Window.partitionBy(*CELL, "span").orderBy("t")
    df = df.withColumn("span", F.floor(F.col("dfb") / days))
    df = df.withColumns({f"_x{k}": F.lead(x, k).over(span) for k in range(1, lags + 1)})
    pairs = F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_x{k}").alias("x")) for k in range(1, lags + 1)))
    df = df.select(*CELL, "span", F.col(cosz).alias("c"), F.explode(pairs).alias("p")).select("*", "p.lag", "p.x").filter("x is not null and c is not null")
    fit = df.groupBy(*CELL, "span", "lag").agg(F.count("*").alias("n"), F.covar_pop("x", "c").alias("xc"), F.stddev_pop("x").alias("sx"), F.stddev_pop("c").alias("sc"))
    fit = fit.filter((F.col("n") > 2) & (F.col("sx") > 1e-9) & (F.col("sc") > 1e-9)).withColumn("r", F.round(F.col("xc") / (F.col("sx") * F.col("sc")), 9))
    best = fit.groupBy(*CELL, "span").agg(F.max(F.struct("r", (-F.col("lag")).alias("back"))).alias("top")).filter(F.col("top.r") > least)
    return best.groupBy((-F.col("top.back")).cast("int").alias("lag")).agg(F.count("*").alias("n"))
