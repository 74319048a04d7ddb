"""Daily patterns: cell series cut into slices from their darkest slot on, verdicts by slice, persistence over slices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import correlation_p

CELL = ("lat_i", "lon_i")
LEAST = 12


def with_slices(cube: DataFrame, length: int, first_day: int, cosz: str = "cosz") -> DataFrame:
    """Adds `slice`: cuts every `length` slots, the first at the first day's darkest slot (modulo `length`); slice 0 lies before it."""
    darkest = F.min(F.when(F.col("dfb") == first_day, F.struct(F.col(cosz), "t"))).over(Window.partitionBy(*CELL)).getField("t") % length
    return cube.withColumn("slice", (F.floor((F.col("t") - darkest) / length) + 1).cast("int"))


def slope_verdicts(sliced: DataFrame, x: str, by: str, lo: float, hi: float, extra: Column | None = None) -> DataFrame:
    """lat_i, lon_i, slice, n, slope, verdict: is x's slope on `by` within [lo, hi], in slices of more than 12 valid slots (and `extra`)?"""
    ok = sliced.filter(F.col(x).isNotNull() & F.col(by).isNotNull() & (F.lit(True) if extra is None else extra))
    sums = ok.groupBy(*CELL, "slice").agg(F.count("*").alias("n"), F.covar_pop(by, x).alias("cov"), F.var_pop(by).alias("var"))
    sums = sums.filter(F.col("n") > LEAST).withColumn("slope", F.when(F.col("var") > 1e-12, F.try_divide(F.col("cov"), F.col("var"))))
    return sums.select(*CELL, "slice", "n", "slope", F.coalesce(F.col("slope").between(lo, hi), F.lit(False)).cast("int").alias("verdict"))


def flat(sliced: DataFrame, x: str, by: str, tolerance: float, extra: Column | None = None) -> DataFrame:
    """slope_verdicts with a symmetric tolerance."""
    return slope_verdicts(sliced, x, by, -tolerance, tolerance, extra)


def correlation_verdicts(sliced: DataFrame, x: str, by: str, tolerance: float) -> DataFrame:
    """lat_i, lon_i, slice, n, r, verdict: is the correlation of x with `by` above 1 - tolerance, in slices of more than 12 valid slots?"""
    ok = sliced.filter(F.col(x).isNotNull() & F.col(by).isNotNull())
    sums = ok.groupBy(*CELL, "slice").agg(F.count("*").alias("n"), F.covar_pop(by, x).alias("cov"), F.stddev_pop(by).alias("sa"), F.stddev_pop(x).alias("sb"))
    r = F.when((F.col("sa") > 1e-9) & (F.col("sb") > 1e-9), F.try_divide(F.col("cov"), F.col("sa") * F.col("sb")))
    return sums.filter(F.col("n") > LEAST).select(*CELL, "slice", "n", r.alias("r"), F.coalesce(r > 1 - tolerance, F.lit(False)).cast("int").alias("verdict"))


def on_slots(sliced: DataFrame, verdicts: DataFrame, column: str, out: str) -> DataFrame:
    """The cube's rows with their slice's value, null where the slice has none."""
    return sliced.join(verdicts.select(*CELL, "slice", F.col(column).alias(out)), [*CELL, "slice"], "left")


def kernel(sigma: float, truncate: float) -> list[float]:
    """Normalised Gaussian weights to int(truncate * sigma + 0.5) on both sides."""
    n = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-n, n + 1)]
    return [x / sum(w) for x in w]


def persistence(verdicts: DataFrame, sigma: float, scope: float) -> DataFrame:
    """Adds `persistent`: verdicts smoothed by a Gaussian over each cell's slices in order (reflected at the ends), over the largest size of all.

    A cell's slices, few a day, are one array.
    """
    w = kernel(sigma, scope / sigma)
    half = len(w) // 2
    series = verdicts.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("slice", F.col("verdict").cast("double").alias("v")))).alias("s"))
    n = F.size("s")

    def at(i: Column, k: int) -> Column:
        j = F.pmod(i + k, 2 * n)
        return F.element_at("s", (F.when(j < n, j).otherwise(2 * n - 1 - j) + 1).cast("int")).getField("v")

    def smooth(item: Column, i: Column) -> Column:
        total = F.lit(0.0)
        for k, x in enumerate(w):
            total = total + x * at(i, k - half)
        return F.struct(item.getField("slice").alias("slice"), total.alias("persistent"))

    out = series.select(*CELL, F.explode(F.transform("s", smooth)).alias("p")).select(*CELL, "p.slice", "p.persistent")
    top = F.broadcast(out.agg(F.max(F.abs("persistent")).alias("_top")))  # a single row
    out = out.join(top).select(*CELL, "slice", F.coalesce(F.try_divide(F.col("persistent"), F.col("_top")), F.lit(0.0)).alias("persistent"))
    return verdicts.join(out, [*CELL, "slice"])


def sun_followers(sliced: DataFrame, vis: str, sir: str, index: str, cosz: str, tolerance: float, valid: Column | None = None) -> DataFrame:
    """t, lat_i, lon_i, slice, index_out, r_vis, p_vis, r_sir, p_sir: in slices of more than 12 valid slots where `vis` follows the
    sun (correlation with `cosz` over 1 - tolerance) and `sir` does not (under 4 tolerances), the index is divided by `cosz`.

    The p-values are those of the two correlations; they gate nothing.  A
    channel that is constant in a slice has neither, and passes no gate.
    """
    ok = F.col(vis).isNotNull() & F.col(sir).isNotNull() & F.col(index).isNotNull() & (F.lit(True) if valid is None else valid)
    use = sliced.filter(ok)
    sums = use.groupBy(*CELL, "slice").agg(
        F.count("*").alias("n"), F.stddev_pop(cosz).alias("sc"),
        *(f(F.col(x)).alias(f"{k}_{x}") for x in (vis, sir) for k, f in (("s", F.stddev_pop), ("c", lambda y: F.covar_pop(F.col(cosz), y)))),
    ).filter(F.col("n") > LEAST)
    for x, name in ((vis, "vis"), (sir, "sir")):
        steady = (F.col("sc") > 1e-9) & (F.col(f"s_{x}") > 1e-9)
        sums = sums.withColumn(f"r_{name}", F.when(steady, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(F.col(f"c_{x}"), F.col("sc") * F.col(f"s_{x}"))))))
        sums = sums.withColumn(f"p_{name}", correlation_p(F.col(f"r_{name}"), F.col("n")))
    follows = F.coalesce((F.col("r_vis") > 1 - tolerance) & (F.col("r_sir") < 4 * tolerance), F.lit(False))
    out = sliced.join(sums.select(*CELL, "slice", "r_vis", "p_vis", "r_sir", "p_sir", follows.alias("_follows")), [*CELL, "slice"], "left")
    changed = F.when(F.col("_follows"), F.try_divide(F.col(index), F.col(cosz))).otherwise(F.col(index))
    return out.select("t", *CELL, "slice", changed.alias("index_out"), "r_vis", "p_vis", "r_sir", "p_sir")


def next_extremes(cube: DataFrame, slots_per_day: int, midday: bool = False, cosz: str = "cosz", around: int = 3) -> DataFrame:
    """lat_i, lon_i, k, t: the chain of darkest (`midday`: brightest) slots of a cell, each looked for from `around` slots before
    to `around` after one day past the one before (the first past slot 0); the first among equals.

    A window in which the cell has no slot (a day that was skipped) gives no
    row, and the chain goes on a day further; it ends with the cell's last slot.
    A cell's slots are one array, folded once.
    """
    value = -F.col(cosz) if midday else F.col(cosz)
    cells = cube.filter(F.col(cosz).isNotNull()).groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("t", value.alias("v")))).alias("s"), F.max("t").alias("last"))
    # windows move on by a day less `around` at least
    steps = F.sequence(F.lit(1), F.greatest(F.floor(F.col("last") / max(1, slots_per_day - around)) + 1, F.lit(1)).cast("int"))

    def step(state: Column, k: Column) -> Column:
        day = state["at"] + slots_per_day
        near = F.filter("s", lambda x: (x["t"] >= day - around) & (x["t"] < day + around))
        best = F.array_min(F.transform(near, lambda x: F.struct(x["v"].alias("v"), x["t"].alias("t"))))["t"]
        found = F.when(best.isNotNull(), F.array(F.struct(k.alias("k"), best.alias("t")))).otherwise(F.array().cast("array<struct<k:int,t:int>>"))
        new = F.struct(F.coalesce(best, day).alias("at"), F.concat(state["found"], found).alias("found"))
        return F.when(day - around > F.col("last"), state).otherwise(new)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<k:int,t:int>>").alias("found"))
    return cells.select(*CELL, F.explode(F.aggregate(steps, start, step)["found"]).alias("f")).select(*CELL, "f.k", "f.t")
