"""The cube: one row per slot and cell, one column per channel; and its dimension tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHANNELS, Profile
from ..operators.neighbourhood import dilate_fixed

#: channel of each kind of event
KINDS = {"error": "fir", "signup": "lir", "purchase": "mir", "view": "sir", "click": "vis"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: off the middle between two roundings, which engines round differently
TIE = 1e-9
#: events that a cell gets on average, and the least cells in a row
EVENTS_A_CELL, LEAST_SIDE = 250, 5


def profile(spark: SparkSession, sf_dir: str) -> Profile:
    """The grid that grows with `events`: as many cells a side as give each EVENTS_A_CELL events (counted in the files' footers)."""
    return Profile.square(max(LEAST_SIDE, math.isqrt(read(spark, sf_dir, "events").count() // EVENTS_A_CELL)))


def scan_channels(spark: SparkSession, sf_dir: str, p: Profile = Profile()) -> DataFrame:
    """Observed cells only: t, dfb, slot, lat_i, lon_i and the channels, null where not observed.

    The day range is a filter on the time column, so it reaches the scan; one
    conditional aggregation makes the columns (no second pass as a pivot has).
    """
    days = F.date_add(F.lit("1980-01-01").cast("date"), p.first_day), F.date_add(F.lit("1980-01-01").cast("date"), p.last_day + 1)
    events = read(spark, sf_dir, "events").filter((F.col("ts") >= days[0].cast("timestamp")) & (F.col("ts") < days[1].cast("timestamp")))
    cell = F.col("user_id") % (p.n_lat * p.n_lon)
    keyed = events.select(
        F.datediff(F.to_date("ts"), F.lit("1980-01-01").cast("date")).alias("dfb"), F.floor(F.hour("ts") / p.hours_per_slot).cast("int").alias("slot"),
        F.floor(cell / p.n_lon).cast("int").alias("lat_i"), (cell % p.n_lon).cast("int").alias("lon_i"), "event_type", "value",
    )
    mean = {c: F.round(F.avg(F.when(F.col("event_type") == k, F.col("value"))), 6) for k, c in KINDS.items()}
    t = ((F.col("dfb") - p.first_day) * p.slots_per_day + F.col("slot")).cast("int")
    cube = keyed.groupBy("dfb", "slot", "lat_i", "lon_i").agg(*(m.alias(c) for c, m in mean.items()))
    raw = {c: F.col(c) for c in CHANNELS}
    scaled = {c: F.when(raw[c].isNotNull(), F.round((F.least(raw[c] / 200, F.lit(1.2)) if c in ("sir", "vis") else 230 + 0.6 * F.least(raw[c], F.lit(120.0))) + TIE, 6)) for c in CHANNELS}
    return cube.select(t.alias("t"), "dfb", "slot", "lat_i", "lon_i", *(scaled[c].alias(c) for c in CHANNELS))


def time_axis(events: DataFrame, p: Profile = Profile()) -> DataFrame:
    """t, dfb, slot, ts of every slot from the events' first day to their last."""
    t = F.col("t")
    day = lambda end: F.datediff(F.to_date(end("ts")), F.lit("1980-01-01").cast("date")) - p.first_day
    slots = events.agg(F.explode(F.sequence(day(F.min) * p.slots_per_day, (day(F.max) + 1) * p.slots_per_day - 1)).alias("t"))
    dfb = (p.first_day + F.floor(t / p.slots_per_day)).cast("int")
    slot = (t % p.slots_per_day).cast("int")
    ts = F.timestamp_seconds((dfb.cast("long") + 3652) * 86400 + slot * p.hours_per_slot * 3600)
    return slots.select(t.cast("int").alias("t"), dfb.alias("dfb"), slot.alias("slot"), ts.alias("ts"))


def land_mask(spark: SparkSession, sf_dir: str, p: Profile = Profile()) -> DataFrame:
    """lat_i, lon_i, is_land of every cell: land where the customers that fall to it have more than 4,000 on average, sea where there are none."""
    cells = p.n_lat * p.n_lon
    rich = read(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % cells).alias("id")).agg((F.avg("c_acctbal") > 4000).alias("rich"))
    lat, lon = F.floor(F.col("id") / p.n_lon).cast("int"), (F.col("id") % p.n_lon).cast("int")
    return spark.range(cells).join(rich, "id", "left").select(lat.alias("lat_i"), lon.alias("lon_i"), F.coalesce("rich", F.lit(False)).alias("is_land"))


def temperature(spark: SparkSession, sf_dir: str, p: Profile = Profile()) -> DataFrame:
    """Hourly forecast (hour_idx since the first day, lat_i, t2m in degrees Celsius): the usual course, and up to 3 degrees off it by the orders that fall to the hour and latitude."""
    points = p.days * 24 * p.n_lat
    off = F.round(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.avg("o_totalprice") - 200000) / 50000)), 3)
    orders = read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % points).alias("id")).agg(off.alias("off"))
    hour, lat = F.floor(F.col("id") / p.n_lat).cast("int"), (F.col("id") % p.n_lat).cast("int")
    usual = 10.0 + p.lat_step * lat / 2 + (hour % 24) / 4
    return spark.range(points).join(orders, "id", "left").select(hour.alias("hour_idx"), lat.alias("lat_i"), (usual + F.coalesce("off", F.lit(0.0))).alias("t2m"))


def complete_grid(cube: DataFrame, p: Profile = Profile()) -> DataFrame:
    """Every slot and cell once; channels null where the cube has no row.

    The axes come from two generated ranges, whose product is the output
    itself; the cube is joined to it on its key.
    """
    spark = cube.sparkSession
    cells = p.n_lat * p.n_lon
    t, cell = F.floor(F.col("id") / cells).cast("int"), F.col("id") % cells
    axes = spark.range(p.days * p.slots_per_day * cells).select(
        t.alias("t"), (p.first_day + F.floor(t / p.slots_per_day)).cast("int").alias("dfb"), (t % p.slots_per_day).cast("int").alias("slot"),
        F.floor(cell / p.n_lon).cast("int").alias("lat_i"), (cell % p.n_lon).cast("int").alias("lon_i"),
    )
    return axes.join(cube.drop("dfb", "slot"), ["t", "lat_i", "lon_i"], "left")


def cos_zenith(p: Profile = Profile()) -> Column:
    """Cosine of the solar zenith angle at the middle of the slot (Cooper's declination, solar time)."""
    hour = F.col("slot") * p.hours_per_slot + p.hours_per_slot / 2
    doy = (F.col("dfb") - p.first_day) % 365 + 1
    dec = F.radians(23.45 * F.sin(2 * 3.141592653589793 * (284 + doy) / 365))
    lat = F.radians(p.lat0 + p.lat_step * F.col("lat_i"))
    return F.round(F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(F.radians(15.0 * (hour - 12))), 9)


def load_cube(spark: SparkSession, sf_dir: str, p: Profile = Profile()) -> DataFrame:
    """The complete cube with is_land, near_land (it or a neighbour is), cosz, zen and the forecast temperature t2m (kelvin).

    is_land has one row per cell and t2m one per hour and latitude; both are
    joined by key, and Spark broadcasts them only under its size threshold.
    """
    land = dilate_fixed(land_mask(spark, sf_dir, p), "is_land", "near_land")
    cube = complete_grid(scan_channels(spark, sf_dir, p), p).join(land, ["lat_i", "lon_i"])
    hour = (F.col("t") * p.hours_per_slot).alias("hour_idx")
    cube = cube.withColumn("hour_idx", hour).join(temperature(spark, sf_dir, p), ["hour_idx", "lat_i"]).drop("hour_idx")
    return cube.withColumn("cosz", cos_zenith(p)).withColumn("zen", F.acos("cosz")).withColumn("t2m", F.col("t2m") + 273.15)


def write_cube(cube: DataFrame, path: str) -> None:
    """Parquet by day, so that day ranges prune partitions."""
    cube.write.mode("overwrite").partitionBy("dfb").parquet(path)


def read_cube(
    spark: SparkSession, path: str, days: tuple[int, int] | None = None, lats: tuple[int, int] | None = None, lons: tuple[int, int] | None = None,
    slot_step: int = 1, columns: list[str] | None = None,
) -> DataFrame:
    """A written cube (channels or classes): days and extents (both ends included) reach the scan, every slot_step-th slot stays."""
    cube = spark.read.parquet(path)
    for c, span in (("dfb", days), ("lat_i", lats), ("lon_i", lons)):
        if span is not None:
            cube = cube.filter(F.col(c).between(*span))
    if slot_step > 1:
        cube = cube.filter(F.col("slot") % slot_step == 0)
    return cube.select(*columns) if columns else cube


def in_range(df: DataFrame, columns: list[str], lo: float, hi: float) -> DataFrame:
    """One row: for each column, are all its values within [lo, hi] (missing ones left out)?"""
    return df.agg(*(F.coalesce(F.bool_and(F.col(c).between(lo, hi)), F.lit(True)).alias(c) for c in columns))


def for_export(cube: DataFrame, p: Profile = Profile(), fill: float = -999.0) -> DataFrame:
    """Latitudes from north to south, missing channels as `fill`."""
    return cube.withColumn("lat_i", F.lit(p.n_lat - 1) - F.col("lat_i")).fillna(fill, list(CHANNELS))


def nearest(lat: Column, lon: Column, p: Profile = Profile()) -> tuple[Column, Column]:
    """(lat_i, lon_i) of the nearest cell, null outside the grid; longitudes modulo 360."""
    i = F.floor((lat - p.lat0) / p.lat_step + 0.5).cast("int")
    j = F.floor(F.pmod(lon - p.lon0, F.lit(360.0)) / p.lat_step + 0.5).cast("int")
    return F.when(i.between(0, p.n_lat - 1), i), F.when(j.between(0, p.n_lon - 1), j)
