"""Per-cell time operators: cleaning, gap filling, variability, rolling statistics, detrending.

All windows contain (lat_i, lon_i), so one repartition on the cell serves them all.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CHANNELS
from ..functions.physics import invalid_value

CELL = ("lat_i", "lon_i")
FILL = -10.0


def by_time():
    return Window.partitionBy(*CELL).orderBy("t")


def by_day():
    return Window.partitionBy(*CELL, "slot").orderBy("dfb")


def invalid_any(channels: tuple[str, ...] = CHANNELS) -> Column:
    return reduce(lambda a, b: a | b, (invalid_value(F.col(c)) for c in channels))


def missing_runs(cube: DataFrame, channel: str) -> DataFrame:
    """Adds `run` (number of the run of missing or present slots) and `run_length`; both by cell."""
    bad = invalid_value(F.col(channel))
    before = F.lag(bad).over(by_time())
    starts = F.when(before.isNull() | (before != bad), 1).otherwise(0)
    marked = cube.withColumn("missing", bad).withColumn("run", F.sum(starts).over(by_time().rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.withColumn("run_length", F.count("*").over(Window.partitionBy(*CELL, "run")).cast("int"))


def interpolate_gaps(cube: DataFrame, channel: str, longest: int = 3, method: str = "linear") -> DataFrame:
    """Adds `filled`: gaps of up to `longest` slots between valid neighbours are filled."""
    x = F.when(~invalid_value(F.col(channel)), F.col(channel))
    past, future = by_time().rowsBetween(Window.unboundedPreceding, -1), by_time().rowsBetween(1, Window.unboundedFollowing)
    when = F.when(x.isNotNull(), F.col("t"))
    cube = cube.withColumns({
        "x0": F.last(x, True).over(past), "t0": F.last(when, True).over(past),
        "x1": F.first(x, True).over(future), "t1": F.first(when, True).over(future),
    })
    gap = F.col("t1") - F.col("t0") - 1
    linear = ((F.col("t1") - F.col("t")) * F.col("x0") + (F.col("t") - F.col("t0")) * F.col("x1")) / (F.col("t1") - F.col("t0"))
    fill = {"linear": linear, "keep-last": F.col("x0"), "none": F.lit(None).cast("double")}[method]
    return cube.withColumn("filled", F.when(x.isNotNull(), x).when(gap <= longest, fill)).drop("x0", "t0", "x1", "t1")


def mask_channels(cube: DataFrame, channels: tuple[str, ...] = CHANNELS, longest: int = 3) -> DataFrame:
    """The channels with short gaps filled, and all of them -1 where any is still missing."""
    for c in channels:
        cube = interpolate_gaps(cube, c, longest).withColumn(c, F.col("filled")).drop("filled")
    bad = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in channels))
    return cube.withColumns({c: F.when(bad, -1.0).otherwise(F.col(c)) for c in channels})


def step_variability(x: Column, step: int = 1, absolute: bool = False, drops_only: bool = False) -> Column:
    """x minus its value `step` slots before, FILL where either is missing."""
    d = x - F.lag(x, step).over(by_time())
    if drops_only:
        d = -F.least(d, F.lit(0.0))
    return F.coalesce(F.abs(d) if absolute else d, F.lit(FILL))


_NEAR, _WIDE = (1, 2, -1, -2), (1, 2, 3, -1, -2, -3)


def _day_lags(x: Column, lags: tuple[int, ...] = _NEAR) -> list[Column]:
    return [F.lag(x, k).over(by_day()) if k > 0 else F.lead(x, -k).over(by_day()) for k in lags]


def positive_variability(x: Column, only_past: bool = False, skip: Column | None = None) -> Column:
    """Largest rise over the same slot one or two days away (`only_past`: before), 0 if none; where `skip` holds no value is taken."""
    x = x if skip is None else F.when(~skip, x)
    return F.greatest(F.lit(0.0), *(x - y for y in _day_lags(x, (1, 2) if only_past else _NEAR)))


def negative_variability(x: Column) -> Column:
    """Largest drop below the same slot one or two days away, 0 if none."""
    return F.greatest(F.lit(0.0), *(y - x for y in _day_lags(x)))


def _in_range(first_day: int, last_day: int, lags: tuple[int, ...] = _NEAR) -> list[Column]:
    return [(F.col("dfb") - k).between(first_day, last_day) for k in lags]


def lasting_rise(x: Column, first_day: int, last_day: int) -> Column:
    """Smallest rise over the days in range one or two away; 0 if any is missing or higher."""
    each = [F.when(ok, F.coalesce(x - y, F.lit(FILL))) for y, ok in zip(_day_lags(x), _in_range(first_day, last_day), strict=True)]
    return F.greatest(F.lit(0.0), F.coalesce(F.least(*each), F.lit(FILL)))


def total_variability(x: Column, first_day: int, last_day: int) -> Column:
    """Smallest absolute difference to the days in range one or two away, from six days on also three away
    for all but the first and last two days; FILL if any is missing, and for the inner days of four."""
    day, days = F.col("dfb") - first_day, last_day - first_day + 1
    inner = day.between(2, days - 3) if days >= 6 else F.lit(False)
    used = [ok & inner if abs(k) == 3 else ok for k, ok in zip(_WIDE, _in_range(first_day, last_day, _WIDE), strict=True)]
    each = [F.when(ok, F.coalesce(F.abs(x - y), F.lit(FILL))) for y, ok in zip(_day_lags(x, _WIDE), used, strict=True)]
    least = F.coalesce(F.least(*each), F.lit(FILL))
    return F.when(day.between(1, 2), F.lit(FILL)).otherwise(least) if days == 4 else least


def rolling_mean(x: Column, window: int) -> Column:
    """Trailing mean; the first window - 1 values stay."""
    return F.when(F.row_number().over(by_time()) >= window, F.avg(x).over(by_time().rowsBetween(1 - window, 0))).otherwise(x)


def centred_mean(x: Column, n: int = 5) -> Column:
    """Mean over the slots at most n away."""
    return F.avg(x).over(by_time().rowsBetween(-n, n))


def followed(flag: Column, lags: tuple[int, ...]) -> Column:
    """True where the flag held at all these slots before."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.lag(flag, k).over(by_time()), F.lit(False)) for k in lags))


def rolling_median(x: Column, window: int) -> Column:
    """Trailing median of the values present, from the window's end on."""
    held = F.array_sort(F.filter(F.collect_list(x).over(by_time().rowsBetween(1 - window, 0)), lambda v: v.isNotNull()))
    n = F.size(held)
    middle = (F.try_element_at(held, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(held, (F.floor(n / 2) + 1).cast("int"))) / 2
    return F.when(F.row_number().over(by_time()) >= window, F.when(n > 0, middle)).otherwise(x)


def detrended(x: Column, by: Column) -> Column:
    """x less its least-squares slope on `by` (the intercept stays)."""
    both = x.isNotNull() & by.isNotNull()
    u, v = F.when(both, by), F.when(both, x)
    window = Window.partitionBy(*CELL)
    var = F.var_pop(u).over(window)
    return x - F.when(var > 0, F.try_divide(F.covar_pop(u, v).over(window), var)).otherwise(0.0) * by


def high_pass(order: int, cutoff: float) -> list[tuple[float, float, float, float, float]]:
    """Butterworth high pass of even order as sections (b0, b1, b2, a1, a2); cutoff as a share of half the sampling rate."""
    k = math.tan(math.pi * cutoff / 2)
    damp = [2 * math.cos((2 * i + 1) * math.pi / (2 * order)) for i in range(order // 2)]
    norm = [1 / (1 + k * d + k * k) for d in damp]
    return [(n, -2 * n, n, 2 * (k * k - 1) * n, (1 - k * d + k * k) * n) for d, n in zip(damp, norm, strict=True)]


def low_cut(cube: DataFrame, channel: str, cutoff: float = 0.1) -> DataFrame:
    """t, lat_i, lon_i, filtered: 8th-order Butterworth high pass forward along t, by cell, from rest; missing counts as 0 and gives 0."""
    sections = high_pass(8, cutoff)

    def run(part):
        part = part.sort_values("t")
        y = part[channel].fillna(0.0).tolist()
        for b0, b1, b2, a1, a2 in sections:
            u = v = 0.0
            for i, x in enumerate(y):
                y[i] = b0 * x + u
                u, v = b1 * x - a1 * y[i] + v, b2 * x - a2 * y[i]
        return part[["t", "lat_i", "lon_i"]].assign(filtered=np.where(part[channel].isna(), 0.0, y))

    return cube.select("t", *CELL, channel).groupBy(*CELL).applyInPandas(run, "t int, lat_i int, lon_i int, filtered double")
