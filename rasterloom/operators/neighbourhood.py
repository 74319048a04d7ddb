"""3x3 neighbourhood operators in two separable passes: along longitude, then along latitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Profile


def _lines():
    """Along longitude, then along latitude."""
    return Window.partitionBy("t", "lat_i").orderBy("lon_i"), Window.partitionBy("t", "lon_i").orderBy("lat_i")


def _three(c: str, w) -> list[Column]:
    """Left, self, right; at the border the edge cell stands in (reflection)."""
    return [F.coalesce(F.lag(c).over(w), F.col(c)), F.col(c), F.coalesce(F.lead(c).over(w), F.col(c))]


def _passes(df: DataFrame, columns: dict[str, Column], combine) -> DataFrame:
    df = df.withColumns(columns)
    for w in _lines():
        df = df.withColumns({c: combine(_three(c, w)) for c in columns})
    return df


def box_sum(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return _passes(df, columns, lambda v: v[0] + v[1] + v[2])


def local_max(df: DataFrame, x: str, out: str) -> DataFrame:
    return _passes(df, {out: F.col(x)}, lambda v: F.greatest(*v))


def local_min(df: DataFrame, x: str, out: str) -> DataFrame:
    return _passes(df, {out: F.col(x)}, lambda v: F.least(*v))


def dilate_fixed(df: DataFrame, flag: str, out: str) -> DataFrame:
    """Adds `out`: `flag`, which does not change over time, holds at a cell or one of its eight neighbours.

    Dilates the cells once (one row each), not every slot of them; a cell's
    missing flag does not hold.
    """
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    cells = df.filter(F.col(flag)).select("lat_i", "lon_i").distinct()
    near = cells.withColumn("_s", steps).select((F.col("lat_i") + F.col("_s.i")).alias("lat_i"), (F.col("lon_i") + F.col("_s.j")).alias("lon_i")).distinct()
    return df.join(near.withColumn(out, F.lit(True)), ["lat_i", "lon_i"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def dilate(df: DataFrame, flag: str, out: str) -> DataFrame:
    """3x3 binary dilation; outside counts as false."""
    return _passes(df, {out: F.col(flag).cast("int")}, lambda v: F.greatest(*v)).withColumn(out, F.col(out) == 1)


def local_std(df: DataFrame, x: str, out: str) -> DataFrame:
    """Population standard deviation of the 3x3 box with reflected borders."""
    df = box_sum(df, {"_s": F.col(x), "_q": F.col(x) * F.col(x)})
    return df.withColumn(out, F.sqrt(F.greatest(F.col("_q") / 9 - F.pow(F.col("_s") / 9, 2), F.lit(0.0)))).drop("_s", "_q")


def contrast(df: DataFrame, x: str, out: str) -> DataFrame:
    """The cell less its eight neighbours' mean, with reflected borders."""
    df = box_sum(df, {"_s": F.col(x)})
    return df.withColumn(out, F.col(x) * 9 / 8 - F.col("_s") / 8).drop("_s")


def neighbours(df: DataFrame, columns: list[str], scope: int = 1, p: Profile = Profile()) -> DataFrame:
    """One row for each cell of the box around each cell (borders reflected): t, lat_i, lon_i and the columns."""
    def mirrored(c: Column, n: int) -> list[Column]:
        # a cell is met by every box that it lies in, and by boxes whose border reflects into it
        moved = [c + d for d in range(-scope, scope + 1)]
        back = [-1 - c + d for d in range(-scope, scope + 1)] + [2 * n - 1 - c + d for d in range(-scope, scope + 1)]
        inside = [F.when((m >= 0) & (m < n), m) for m in moved]
        # box of cell m covers index -1-c (mirror of c) iff |(-1-c) - m| <= scope
        return inside + [F.when((m >= 0) & (m < n), m) for m in back]

    lat, lon = (F.array_compact(F.array(*mirrored(F.col(c), n))) for c, n in (("lat_i", p.n_lat), ("lon_i", p.n_lon)))
    out = df.select("t", F.explode(lat).alias("la"), lon.alias("lons"), *columns)
    out = out.select("t", "la", F.explode("lons").alias("lo"), *columns)
    return out.select("t", F.col("la").cast("int").alias("lat_i"), F.col("lo").cast("int").alias("lon_i"), *columns)


def median_filter(df: DataFrame, x: str, out: str, scope: int = 1, p: Profile = Profile()) -> DataFrame:
    """t, lat_i, lon_i and the median of the box around each cell (reflected borders, missing values left out).

    The 3x3 box comes from two windows of lags; a wider one deals every cell to the boxes that it lies in.
    """
    if scope > 1:
        return neighbours(df, [x], scope, p).groupBy("t", "lat_i", "lon_i").agg(F.median(x).alias(out))
    rows, columns = _lines()
    df = df.withColumns(dict(zip(("_l", "_m", "_r"), _three(x, rows), strict=True)))
    nine = F.array(*(v for c in ("_l", "_m", "_r") for v in _three(c, columns)))
    df = df.withColumn("_box", F.array_sort(F.array_compact(nine)))
    n = F.size("_box")
    middle = (F.try_element_at("_box", F.floor((n + 1) / 2).cast("int")) + F.try_element_at("_box", (F.floor(n / 2) + 1).cast("int"))) / 2
    return df.select("t", "lat_i", "lon_i", F.when(n > 0, middle).alias(out))


def masked(df: DataFrame, mask: str, out: str) -> DataFrame:
    """Adds `out`: the mask, or that of a cell beside, above or below (a cross)."""
    rows, columns = _lines()
    beside = [F.coalesce(f(mask).over(w), F.lit(False)) for w in (rows, columns) for f in (F.lag, F.lead)]
    return df.withColumn(out, F.col(mask) | beside[0] | beside[1] | beside[2] | beside[3])


def blur(df: DataFrame, x: str, out: str) -> DataFrame:
    """3x3 binomial blur (1 2 1); outside the border the cell on the other side of the edge cell stands in."""
    df = df.withColumn(out, F.col(x))
    for w in _lines():
        left, right = F.lag(out).over(w), F.lead(out).over(w)
        df = df.withColumn(out, (F.coalesce(left, right, F.col(out)) + 2 * F.col(out) + F.coalesce(right, left, F.col(out))) / 4)
    return df


def patch(df: DataFrame, x: str, prefix: str) -> DataFrame:
    """Adds prefix0..prefix8, the 3x3 patch around each inner cell in reading order; -1 where it leaves the grid."""
    rows, columns = _lines()
    df = df.withColumns({"_p0": F.lag(x).over(rows), "_p1": F.col(x), "_p2": F.lead(x).over(rows)})
    nine = [f(f"_p{j}").over(columns) if f else F.col(f"_p{j}") for f in (F.lag, None, F.lead) for j in range(3)]
    return df.withColumns({f"{prefix}{i}": F.coalesce(c, F.lit(-1.0)) for i, c in enumerate(nine)}).drop("_p0", "_p1", "_p2")
