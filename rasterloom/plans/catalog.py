"""The query catalogue: each operator over the driver's tables, with the same as DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BOLTZMANN, CHANNELS, LIGHT, PLANCK, Profile
from ..functions import physics as P
from ..operators import classify, models, navigation, neighbourhood, patterns, segment, spectrum, stats, timeseries
from ..sources import cube as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PROFILE = Profile()
KEY = ["t", "lat_i", "lon_i"]


def query(sql: str | None = None):
    """Register the function under its name; `sql` may use the views `obs` and `cube`."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            head = next((h for h in ("WITH RECURSIVE ", "WITH ") if body.startswith(h)), "")
            ORACLE[f.__name__] = f"{head or 'WITH '}{_BASE}" + (", " if head else " ") + body[len(head) :]
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.load_cube(spark, sf_dir, source.profile(spark, sf_dir))


def _scale(c: str) -> str:
    body = f"least({c} / 200, 1.2)" if c in ("sir", "vis") else f"230 + 0.6 * least({c}, 120.0)"
    return f"CASE WHEN {c} IS NOT NULL THEN round({body} + {source.TIE}, 6) END AS {c}"


_BASE = f"""grid AS (
  SELECT greatest({source.LEAST_SIDE}, CAST(floor(sqrt(count(*) // {source.EVENTS_A_CELL})) AS INTEGER)) AS side FROM events
), ev AS (
  SELECT datediff('day', DATE '1980-01-01', CAST(ts AS DATE)) AS dfb, CAST(hour(ts) // 6 AS INTEGER) AS slot,
    CAST((user_id % (side * side)) // side AS INTEGER) AS lat_i, CAST(user_id % (side * side) % side AS INTEGER) AS lon_i, event_type, value
  FROM events, grid WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'
), mean AS (
  SELECT dfb, slot, lat_i, lon_i, {", ".join(f"round(avg(value) FILTER (event_type = '{k}'), 6) AS {c}" for k, c in source.KINDS.items())} FROM ev GROUP BY ALL
), obs AS (
  SELECT CAST((dfb - 16071) * 4 + slot AS INTEGER) AS t, CAST(dfb AS INTEGER) AS dfb, slot, lat_i, lon_i, {", ".join(map(_scale, CHANNELS))} FROM mean
), axes AS (
  SELECT CAST(t AS INTEGER) AS t, CAST(16071 + t // 4 AS INTEGER) AS dfb, CAST(t % 4 AS INTEGER) AS slot, CAST(lat AS INTEGER) AS lat_i, CAST(lon AS INTEGER) AS lon_i
  FROM range(120) a(t), (SELECT unnest(range(side)) AS lat FROM grid) b, (SELECT unnest(range(side)) AS lon FROM grid) c
), lit AS (
  SELECT *, round(sin(radians(10.0 + step * lat_i)) * sin(d) + cos(radians(10.0 + step * lat_i)) * cos(d) * cos(radians(15.0 * (slot * 6 + 3 - 12))), 9) AS cosz
  FROM (SELECT *, 10.0::DOUBLE / side AS step, radians(23.45 * sin(2 * 3.141592653589793::DOUBLE * (284 + (dfb - 16071) % 365 + 1) / 365)) AS d FROM axes, grid)
), rich AS (
  SELECT CAST(c_custkey % (side * side) // side AS INTEGER) AS lat_i, CAST(c_custkey % (side * side) % side AS INTEGER) AS lon_i, avg(c_acctbal) > 4000 AS rich FROM customer, grid GROUP BY ALL
), land AS (
  SELECT lat_i, lon_i, coalesce(rich, false) AS is_land FROM (SELECT DISTINCT lat_i, lon_i FROM axes) LEFT JOIN rich USING (lat_i, lon_i)
), course AS (
  SELECT CAST(o_orderkey % (720 * side) // side AS INTEGER) AS hour_idx, CAST(o_orderkey % (720 * side) % side AS INTEGER) AS lat_i,
    round(greatest(-3.0, least(3.0, (avg(o_totalprice) - 200000) / 50000)), 3) AS off
  FROM orders, grid GROUP BY ALL
), cube AS (
  SELECT l.t, l.dfb, l.slot, l.lat_i, l.lon_i, fir, lir, mir, sir, vis, is_land, cosz, acos(cosz) AS zen,
    10.0::DOUBLE + step * l.lat_i / 2 + ((l.t * 6) % 24) / 4.0 + coalesce(off, 0.0) + 273.15 AS t2m
  FROM lit l JOIN land USING (lat_i, lon_i) LEFT JOIN course ON course.hour_idx = l.t * 6 AND course.lat_i = l.lat_i LEFT JOIN (SELECT t, lat_i, lon_i, fir, lir, mir, sir, vis FROM obs) o USING (t, lat_i, lon_i)
)"""
_PX = "PARTITION BY lat_i, lon_i ORDER BY t"
_DAY = "PARTITION BY lat_i, lon_i, slot ORDER BY dfb"


# scans -----------------------------------------------------------------------------------------------------


@query("SELECT t, dfb, slot, lat_i, lon_i, fir, lir, mir, sir, vis FROM obs")
def scan_cube(spark, sf_dir):
    return source.scan_channels(spark, sf_dir, source.profile(spark, sf_dir))


@query("SELECT t, dfb, slot, lat_i, lon_i, fir, lir, mir, sir, vis FROM cube")
def grid_complete(spark, sf_dir):
    p = source.profile(spark, sf_dir)
    return source.complete_grid(source.scan_channels(spark, sf_dir, p), p)


@query("SELECT CAST(t AS INTEGER) AS t, CAST(16071 + t // 4 AS INTEGER) AS dfb, CAST(t % 4 AS INTEGER) AS slot, TIMESTAMP '2024-01-01' + to_hours(CAST(6 * t AS INTEGER)) AS ts FROM (SELECT unnest(range(4 * (datediff('day', DATE '2024-01-01', CAST(min(ts) AS DATE))), 4 * (datediff('day', DATE '2024-01-01', CAST(max(ts) AS DATE)) + 1))) AS t FROM events)")
def time_axis(spark, sf_dir):
    return source.time_axis(source.read(spark, sf_dir, "events"), PROFILE).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT t, lat_i, lon_i, round(t2m, 6) AS t2m, is_land, round(cosz, 6) + 0.0 AS cosz FROM cube")
def temperature_asof(spark, sf_dir):
    return _cube(spark, sf_dir).select(*KEY, F.round("t2m", 6).alias("t2m"), "is_land", r("cosz").alias("cosz"))


# cleaning and gaps -----------------------------------------------------------------------------------------


@query("SELECT t, lat_i, lon_i, fir IS NULL OR lir IS NULL OR mir IS NULL OR sir IS NULL OR vis IS NULL OR greatest(fir, lir, mir, sir, vis) > 350 OR least(fir, lir, mir, sir, vis) < 0 AS invalid FROM cube")
def invalid_mask(spark, sf_dir):
    return _cube(spark, sf_dir).select(*KEY, timeseries.invalid_any().alias("invalid"))


@query(f"""
WITH a AS (SELECT t, lat_i, lon_i, vis IS NULL AS missing, lag(vis IS NULL) OVER ({_PX}) AS before FROM cube),
b AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> missing THEN 1 ELSE 0 END) OVER ({_PX} ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT t, lat_i, lon_i, missing, CAST(run AS INTEGER) AS run, CAST(count(*) OVER (PARTITION BY lat_i, lon_i, run) AS INTEGER) AS run_length FROM b""")
def missing_runs(spark, sf_dir):
    return timeseries.missing_runs(_cube(spark, sf_dir), "vis").select(*KEY, "missing", "run", "run_length")


@query(f"""
WITH a AS (
  SELECT t, lat_i, lon_i, vis, last_value(vis IGNORE NULLS) OVER ({_PX} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x0,
    last_value(CASE WHEN vis IS NOT NULL THEN t END IGNORE NULLS) OVER ({_PX} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t0,
    first_value(vis IGNORE NULLS) OVER ({_PX} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS x1,
    first_value(CASE WHEN vis IS NOT NULL THEN t END IGNORE NULLS) OVER ({_PX} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t1
  FROM cube
)
SELECT t, lat_i, lon_i, round(CASE WHEN vis IS NOT NULL THEN vis WHEN t1 - t0 - 1 <= 3 THEN ((t1 - t) * x0 + (t - t0) * x1) / (t1 - t0) END, 9) AS filled FROM a""")
def interpolate_gaps(spark, sf_dir):
    return timeseries.interpolate_gaps(_cube(spark, sf_dir), "vis").select(*KEY, F.round("filled", 9).alias("filled"))


# indexes ---------------------------------------------------------------------------------------------------

_K = PLANCK * LIGHT / (BOLTZMANN * 2.0e-6)


@query(f"""
SELECT t, lat_i, lon_i, round(mir - lir, 6) + 0.0 AS cli, round((mir - lir) / greatest(cosz, 0.05), 6) + 0.0 AS cli_mu,
  round((mir - lir) / nullif(mir + lir, 0), 6) + 0.0 AS cli_norm, round(1 - exp(-{_K!r}::DOUBLE * (1.0 / lir - 1.0 / mir)), 6) + 0.0 AS cli_eps FROM cube""")
def cloud_index(spark, sf_dir):
    c, mir, lir = F.col("cosz"), F.col("mir"), F.col("lir")
    kinds = {"cli": "default", "cli_mu": "mu-normalization", "cli_norm": "norm-diff", "cli_eps": "epsilon"}
    return _cube(spark, sf_dir).select(*KEY, *(r(P.cloud_index(c, mir, lir, m)).alias(n) for n, m in kinds.items()))


@query("""
SELECT t, lat_i, lon_i, round((vis - sir) / greatest(sir + vis, 0.02), 6) + 0.0 AS ndsi,
  round((vis - sir) / greatest(sir + vis, 0.02) + 0.15 * pow(1 - cos(zen), 2), 6) + 0.0 AS ndsi_zenith, round(CASE WHEN sir IS NOT NULL THEN vis / greatest(sir, 0.02) END, 6) + 0.0 AS ratio FROM cube""")
def snow_index(spark, sf_dir):
    vis, sir, zen = F.col("vis"), F.col("sir"), F.col("zen")
    return _cube(spark, sf_dir).select(*KEY, r(P.snow_index(vis, sir)).alias("ndsi"), r(P.snow_index(vis, sir, zen, kind="ndsi-zenith")).alias("ndsi_zenith"), r(P.snow_index(vis, sir, kind="ratio")).alias("ratio"))


def _bt(wave: float, eps: float, t: str = "t2m") -> str:
    a = PLANCK / BOLTZMANN * LIGHT / wave
    return f"({a!r}::DOUBLE / ln(1 + (exp({a!r}::DOUBLE / {t}) - 1) / {eps}))"


@query(f"SELECT t, lat_i, lon_i, round({_bt(10.4e-6, 0.95)}, 6) AS lir_fc, round({_bt(12.4e-6, 0.95)}, 6) AS fir_fc, round({_bt(12.4e-6, 0.85)}, 6) AS cold_fc FROM cube")
def forecast_brightness(spark, sf_dir):
    t = F.col("t2m")
    return _cube(spark, sf_dir).select(*KEY, F.round(P.brightness_temperature(t, 10.4e-6, 0.95), 6).alias("lir_fc"), F.round(P.brightness_temperature(t, 12.4e-6, 0.95), 6).alias("fir_fc"), F.round(P.brightness_temperature(t, 12.4e-6, 0.85), 6).alias("cold_fc"))


@query("""
WITH s AS (SELECT min(vis) AS lo, max(vis) AS hi, max(abs(vis)) AS top, avg(vis) AS m, stddev_pop(vis) AS sd FROM cube)
SELECT t, lat_i, lon_i, round(vis / nullif(top, 0), 6) + 0.0 AS n_max, round(vis - m, 6) + 0.0 AS n_centered, round(vis / nullif(sd, 0), 6) + 0.0 AS n_reduced,
  round((vis - m) / nullif(sd, 0), 6) + 0.0 AS n_standard, coalesce(CAST(floor(255 * (vis - lo) / nullif(hi - lo, 0)) AS INTEGER), 0) AS n_gray FROM cube, s""")
def normalize(spark, sf_dir):
    kinds = {"n_max": "max", "n_centered": "centered", "n_reduced": "reduced", "n_standard": "standard", "n_gray": "gray-scale"}
    out = stats.normalize_all(_cube(spark, sf_dir), "vis", kinds)
    return out.select(*KEY, *(r(k).alias(k) for k in kinds if k != "n_gray"), "n_gray")


# variability -----------------------------------------------------------------------------------------------


@query(f"""
WITH a AS (SELECT t, lat_i, lon_i, vis - lag(vis) OVER ({_PX}) AS d FROM cube)
SELECT t, lat_i, lon_i, round(coalesce(d, -10.0), 6) + 0.0 AS step, round(coalesce(abs(d), -10.0), 6) + 0.0 AS absolute,
  round(coalesce(CASE WHEN d IS NOT NULL THEN -least(d, 0.0) END, -10.0), 6) + 0.0 AS drops FROM a""")
def variability_step(spark, sf_dir):
    x = F.col("vis")
    drop = F.when(x.isNotNull() & F.lag(x).over(timeseries.by_time()).isNotNull(), timeseries.step_variability(x, drops_only=True)).otherwise(timeseries.FILL)
    return _cube(spark, sf_dir).select(*KEY, r(timeseries.step_variability(x)).alias("step"), r(timeseries.step_variability(x, absolute=True)).alias("absolute"), r(drop).alias("drops"))


_LAGS = ", ".join(f"{f}({{x}}, {k}) OVER ({_DAY}) AS {n}" for f, k, n in (("lag", 1, "p1"), ("lag", 2, "p2"), ("lead", 1, "f1"), ("lead", 2, "f2")))
_RANGE = {"p1": "dfb - 1 >= 16071", "p2": "dfb - 2 >= 16071", "f1": "dfb + 1 <= 16100", "f2": "dfb + 2 <= 16100"}


@query(f"""
WITH a AS (SELECT *, {_LAGS.format(x="vis")} FROM cube)
SELECT t, lat_i, lon_i, round(greatest(0.0, {", ".join(f"vis - {k}" for k in _RANGE)}), 6) + 0.0 AS rise, round(greatest(0.0, {", ".join(f"{k} - vis" for k in _RANGE)}), 6) + 0.0 AS fall FROM a""")
def day_variability(spark, sf_dir):
    x = F.col("vis")
    return _cube(spark, sf_dir).select(*KEY, r(timeseries.positive_variability(x)).alias("rise"), r(timeseries.negative_variability(x)).alias("fall"))


# V5: days at most two apart; V3: from six days on three apart for the days 2 to n - 3 of n = 30; a missing value gives -10
@query("""
WITH pairs AS (
  SELECT a.t, a.lat_i, a.lon_i, abs(a.dfb - b.dfb) AS apart, a.dfb - 16071 AS day, a.vis - b.vis AS d
  FROM cube a JOIN cube b ON a.lat_i = b.lat_i AND a.lon_i = b.lon_i AND a.slot = b.slot AND a.dfb <> b.dfb AND abs(a.dfb - b.dfb) <= 3
) SELECT t, lat_i, lon_i, round(greatest(0.0, min(coalesce(d, -10.0)) FILTER (apart <= 2)), 6) + 0.0 AS lasting,
  round(min(coalesce(abs(d), -10.0)) FILTER (apart <= 2 OR day BETWEEN 2 AND 30 - 3), 6) + 0.0 AS total FROM pairs GROUP BY ALL""")
def lasting_variability(spark, sf_dir):
    x, days = F.col("vis"), (PROFILE.first_day, PROFILE.last_day)
    return _cube(spark, sf_dir).select(*KEY, r(timeseries.lasting_rise(x, *days)).alias("lasting"), r(timeseries.total_variability(x, *days)).alias("total"))


@query(f"SELECT t, lat_i, lon_i, round(CASE WHEN row_number() OVER ({_PX}) >= 5 THEN avg(lir) OVER ({_PX} ROWS 4 PRECEDING) ELSE lir END, 6) AS smooth FROM cube")
def rolling_mean_time(spark, sf_dir):
    return _cube(spark, sf_dir).select(*KEY, F.round(timeseries.rolling_mean(F.col("lir"), 5), 6).alias("smooth"))


@query(f"SELECT t, lat_i, lon_i, round(CASE WHEN row_number() OVER ({_PX}) >= 5 THEN median(lir) OVER ({_PX} ROWS 4 PRECEDING) ELSE lir END, 6) AS smooth FROM cube")
def rolling_median_time(spark, sf_dir):
    return _cube(spark, sf_dir).select(*KEY, F.round(timeseries.rolling_median(F.col("lir"), 5), 6).alias("smooth"))


@query("""
WITH s AS (SELECT lat_i, lon_i, covar_pop(lir, cosz) AS c, var_pop(cosz) AS v FROM cube WHERE lir IS NOT NULL GROUP BY ALL)
SELECT t, lat_i, lon_i, round(lir - CASE WHEN v > 0 THEN c / nullif(v, 0) ELSE 0.0 END * cosz, 4) + 0.0 AS detrended FROM cube LEFT JOIN s USING (lat_i, lon_i)""")
def cos_zen_detrend(spark, sf_dir):
    return _cube(spark, sf_dir).select(*KEY, r(timeseries.detrended(F.col("lir"), F.col("cosz")), 4).alias("detrended"))


_SLICED = """cut AS (SELECT lat_i, lon_i, arg_min(t, (cosz, t)) % 40 AS cut FROM cube WHERE dfb = 16071 GROUP BY ALL),
sliced AS (SELECT cube.*, CAST(floor((t - cut) / 40) + 1 AS INTEGER) AS slice FROM cube JOIN cut USING (lat_i, lon_i))"""


@query(f"""
WITH {_SLICED}, s AS (SELECT lat_i, lon_i, slice, count(*) AS n, covar_pop(vis, cosz) AS c, var_pop(cosz) AS v FROM sliced WHERE vis IS NOT NULL GROUP BY ALL)
SELECT lat_i, lon_i, slice, n, round(CASE WHEN v > 1e-12 THEN c / nullif(v, 0) END, 4) + 0.0 AS slope,
  CASE WHEN v > 1e-12 AND c / nullif(v, 0) BETWEEN -0.05 AND 0.05 THEN 1 ELSE 0 END AS verdict FROM s WHERE n > 12""")
def cos_zen_slope_slices(spark, sf_dir):
    sliced = patterns.with_slices(_cube(spark, sf_dir), 40, PROFILE.first_day)
    return patterns.slope_verdicts(sliced, "vis", "cosz", -0.05, 0.05).withColumn("slope", r("slope", 4))


@query("""
SELECT lat_i, lon_i, count(*) AS n, round(avg(mir) + 1e-9, 6) AS mean_a, round(avg(lir) + 1e-9, 6) AS mean_b,
  round(CASE WHEN stddev_pop(mir) > 1e-9 AND stddev_pop(lir) > 1e-9 THEN covar_pop(mir, lir) / nullif(stddev_pop(mir) * stddev_pop(lir), 0) END, 6) + 0.0 AS r
FROM cube WHERE mir IS NOT NULL AND lir IS NOT NULL GROUP BY ALL""")
def pixel_correlation(spark, sf_dir):
    return stats.pixel_correlation(_cube(spark, sf_dir), "mir", "lir").withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mean_a", "mean_b")} | {"r": r("r")})


# tests and classes -----------------------------------------------------------------------------------------

_GATE = {k: f"(zen > {math.radians(a)!r} AND zen < {math.radians(b)!r})" for k, (a, b) in P.GATES.items()}


@query(f"SELECT t, lat_i, lon_i, {', '.join(f'{g} AS {k}' for k, g in _GATE.items())} FROM cube")
def angular_gates(spark, sf_dir):
    return _cube(spark, sf_dir).select(*KEY, *(P.gate(F.col("zen"), k).alias(k) for k in P.GATES))


def _test(x: str) -> str:
    return f"coalesce({x}, false)"


_FACTOR = "(1 / pow(greatest(cos(zen), 0.03), 0.3))"
_INDEXED = f"""near AS (
  SELECT c.lat_i, c.lon_i, bool_or(n.is_land) AS near_land FROM land c JOIN land n ON abs(n.lat_i - c.lat_i) <= 1 AND abs(n.lon_i - c.lon_i) <= 1 GROUP BY ALL
), ix AS (
  SELECT *, mir - lir AS cli, (mir - lir) / greatest(cosz, 0.05) AS cli_mu, 1 - exp(-{_K!r}::DOUBLE * (1.0 / fir - 1.0 / lir)) AS cli_eps,
    (vis - sir) / greatest(sir + vis, 0.02) AS ndsi, {_bt(10.4e-6, 0.95)} AS lir_fc, {_bt(12.4e-6, 0.95)} AS fir_fc
  FROM cube JOIN near USING (lat_i, lon_i)
), lagged AS (
  SELECT *, {", ".join(f"{f}(cli, {k}) OVER ({_DAY}) AS c{k}{f[1]}, {f}(ndsi, {k}) OVER ({_DAY}) AS n{k}{f[1]}" for f in ("lag", "lead") for k in (1, 2))},
    ndsi - lag(ndsi) OVER ({_PX}) AS nd FROM ix
), tested AS (
  SELECT *, {_GATE["dawn_day"]} AS dawn_day, {_test("lir_fc - lir > 5")} AS gross, {_test("cli_mu > 10 AND cli_eps < 0.05")} AS opaque, {_test("cli_eps > 0.3")} AS transparent,
    {_test("(lir - fir) - (lir_fc - fir_fc) > 10 AND (lir < 305 OR NOT is_land)")} AS cirrus,
    {_test(f"(NOT near_land AND vis > 0.15 * {_FACTOR}) OR (near_land AND NOT is_land AND vis > 0.3 * {_FACTOR})")} AS sea_coast, {_test("vis > 0.25")} AS bright,
    greatest(0.0, {", ".join(f"cli - c{k}{c}" for k in (1, 2) for c in "ae")}) AS variability FROM lagged
), decided AS (
  SELECT *, dawn_day AND (opaque OR transparent OR sea_coast OR gross OR cirrus) AS cloud_e,
    dawn_day AND ({_test("cli_mu > 10 AND variability > 4")} OR sea_coast OR gross) AS cloud_p,
    dawn_day AND is_land AND {_test("ndsi > 0.3")} AND {_test("cli_mu < 15")} AND bright AS snow_p,
    dawn_day AND is_land AND {_test("ndsi > 0.3")} AND {_test("cli_mu < 15")} AND bright AND {_test("lir - lir_fc > -10")} AND {_test("cli_eps < 0.3")} AS snow_e FROM tested
), early AS (
  SELECT *, CASE WHEN cloud_e THEN 2 WHEN vis IS NULL OR sir IS NULL OR mir IS NULL OR lir IS NULL OR NOT dawn_day THEN 5 WHEN snow_e THEN 1 ELSE 0 END AS early,
    snow_e AND {_test(f"greatest(0.0, {', '.join(f'ndsi - n{k}{c}' for k in (1, 2) for c in 'ae')}) > 0.2 OR greatest(0.0, {', '.join(f'n{k}{c} - ndsi' for k in (1, 2) for c in 'ae')}) > 0.2 OR (coalesce(abs(nd), 10.0) > 0.05 AND coalesce(abs(nd), 10.0) < 10)")} AS suspect FROM decided
), free AS (
  SELECT *, early = 0 AND {" AND ".join(f"coalesce({f}(early = 0, {k}) OVER ({_PX}), false)" for f in ("lag", "lead") for k in (1, 2))} AS steady_free FROM early
), smooth AS (
  SELECT *, CASE WHEN row_number() OVER ({_PX}) >= 5 THEN avg(CASE WHEN steady_free THEN vis ELSE 100.0 END) OVER ({_PX} ROWS 4 PRECEDING) WHEN steady_free THEN vis ELSE 100.0 END AS smooth FROM free
), late AS (
  SELECT *, min(smooth) OVER (PARTITION BY lat_i, lon_i, slot) AS background FROM smooth
), classes AS (
  SELECT t, dfb, slot, lat_i, lon_i, vis, cosz, is_land,
    CAST(CASE WHEN early = 0 AND is_land AND {_test("vis - background > 0.1")} THEN 4 WHEN suspect AND early = 1 THEN 3 ELSE early END AS INTEGER) AS cls FROM late
)"""
_TESTS = ("dawn_day", "gross", "opaque", "transparent", "cirrus", "sea_coast", "bright")


@query(f"WITH {_INDEXED} SELECT t, lat_i, lon_i, {', '.join(_TESTS)} FROM decided")
def threshold_tests(spark, sf_dir):
    return classify.with_tests(classify.with_indexes(_cube(spark, sf_dir))).select(*KEY, *_TESTS)


@query(f"SELECT t, lat_i, lon_i, {_test(f'{_bt(12.4e-6, 0.85)} - lir > 8')} AS cold, {_test('lir < 240')} AS static_cold FROM cube")
def cold_test(spark, sf_dir):
    return _cube(spark, sf_dir).select(*KEY, P.cold(F.col("lir"), F.col("t2m")).alias("cold"), P.test(F.col("lir") < classify.TH.static_temperature).alias("static_cold"))


@query(f"WITH {_INDEXED} SELECT t, lat_i, lon_i, cloud_e AS is_cloud, snow_e AS is_snow FROM decided")
def exhaustive_cloud_snow(spark, sf_dir):
    return classify.with_tests(classify.with_indexes(_cube(spark, sf_dir))).select(*KEY, "is_cloud", "is_snow")


@query(f"WITH {_INDEXED} SELECT t, lat_i, lon_i, cloud_p AS is_cloud, snow_p AS is_snow FROM decided")
def partial_cloud_snow(spark, sf_dir):
    return classify.with_tests(classify.with_indexes(_cube(spark, sf_dir)), exhaustive=False).select(*KEY, "is_cloud", "is_snow")


def _classes(spark, sf_dir) -> DataFrame:
    return classify.classify(_cube(spark, sf_dir), PROFILE)


@query(f"WITH {_INDEXED} SELECT t, dfb, slot, lat_i, lon_i, cls FROM classes")
def static_classifier(spark, sf_dir):
    return _classes(spark, sf_dir).select("t", "dfb", "slot", "lat_i", "lon_i", "cls")


@query(f"""WITH {_INDEXED}, n AS (
  SELECT *, early = 0 AS free, {" AND ".join(f"coalesce({f}(early = 0, {k}) OVER ({_PX}), false)" for f in ("lag", "lead") for k in (1, 2))} AS around FROM early
), s AS (SELECT *, CASE WHEN free AND around THEN vis ELSE 100.0 END AS steady FROM n),
m AS (SELECT *, CASE WHEN row_number() OVER ({_PX}) >= 5 THEN avg(steady) OVER ({_PX} ROWS 4 PRECEDING) ELSE steady END AS smooth FROM s),
b AS (SELECT *, min(smooth) OVER (PARTITION BY lat_i, lon_i, slot) AS background FROM m)
SELECT t, lat_i, lon_i, round(background, 6) AS background, free AND is_land AND {_test("vis - background > 0.1")} AS unstable FROM b""")
def unstable_albedo(spark, sf_dir):
    return classify.unstable_albedo(_cube(spark, sf_dir)).select(*KEY, F.round("background", 6).alias("background"), "unstable")


@query(f"""WITH {_INDEXED}, u AS (
  SELECT *, median(CASE WHEN cls IN (0, 1) THEN vis END) OVER (PARTITION BY lat_i, lon_i, slot) AS usual FROM classes
) SELECT t, lat_i, lon_i, {_test("cls IN (0, 1) AND usual - vis > 0.2 * cosz")} AS shade FROM u""")
def cloud_shade(spark, sf_dir):
    return classify.cloud_shade(_classes(spark, sf_dir)).select(*KEY, "shade")


_CLEAR = "cls IN (0, 5, 9, 10)"


@query(f"""WITH {_INDEXED}, n AS (
  SELECT *, {_CLEAR} AND coalesce(lag({_CLEAR}) OVER ({_PX}), true) AND coalesce(lead({_CLEAR}) OVER ({_PX}), true) AS alone FROM classes
) SELECT t, lat_i, lon_i, CASE WHEN alone AND cls = 5 THEN 1 WHEN alone THEN 0 WHEN cls IN (2, 4) THEN 2 WHEN cls = 13 THEN 4 ELSE 3 END AS reduced, CASE WHEN cls IN (0, 1) THEN 0 ELSE 1 END AS two FROM n""")
def reduce_classes(spark, sf_dir):
    return _classes(spark, sf_dir).select(*KEY, classify.reduce_classes(F.col("cls")).alias("reduced"), classify.reduce_two_classes(F.col("cls")).alias("two"))


@query(f"""
WITH l AS (SELECT *, {_LAGS.format(x="vis")} FROM cube),
a AS (SELECT *, 1 - exp(-{_K!r}::DOUBLE * (1.0 / fir - 1.0 / lir)) AS eps, (vis - sir) / greatest(sir + vis, 0.02) AS ndsi, {_bt(12.4e-6, 0.85)} AS fc,
  greatest(0.0, {", ".join(f"vis - {k}" for k in _RANGE)}) > 0.2 AS varies FROM l),
b AS (SELECT *, {_test("fc - lir > 8")} AS cold, {_test("vis > 0.25")} AS bright, {_test("ndsi > 0.3")} AS snow, {_test("eps > 0.1")} AS slight, {_test("eps > 0.3")} AS obvious FROM a)
SELECT t, dfb, slot, lat_i, lon_i, CASE WHEN cold THEN 8 WHEN bright AND NOT snow AND varies AND slight THEN 2 WHEN obvious THEN 1 WHEN snow AND varies THEN 7 WHEN snow AND slight THEN 6
  WHEN snow AND bright AND is_land THEN 5 WHEN NOT is_land AND bright THEN 12 WHEN vis IS NULL OR lir IS NULL OR mir IS NULL OR NOT {_GATE["dawn_day"]} THEN 13 WHEN bright THEN 3 ELSE 0 END AS cls FROM b""")
def decision_tree_codes(spark, sf_dir):
    return classify.tree_codes(_cube(spark, sf_dir))


@query(f"""WITH {_INDEXED}, s AS (SELECT t, cls, count(*) / (SELECT count(*) FROM classes) AS share FROM classes GROUP BY ALL)
SELECT t, cls, round(share, 6) AS share FROM s WHERE cls IN (SELECT cls FROM s GROUP BY cls HAVING max(share) > 1e-5)""")
def class_statistics(spark, sf_dir):
    return stats.class_statistics(_classes(spark, sf_dir)).select("t", "cls", F.round("share", 6).alias("share"))


@query("SELECT t, round(median(lir), 6) AS median, count(*) AS n FROM cube WHERE lir IS NOT NULL GROUP BY t")
def median_per_slot(spark, sf_dir):
    return stats.medians(_cube(spark, sf_dir), "lir").withColumn("median", F.round("median", 6))


@query(f"""WITH {_INDEXED} SELECT t, lat_i, lon_i, CASE WHEN cloud_e AND NOT cloud_p THEN 1 WHEN cloud_p AND NOT cloud_e THEN -1 ELSE 0 END AS side,
  CASE WHEN vis > 0.35 AND cls = 0 THEN -1 WHEN vis < 0.35 AND cls NOT IN (0, 2, 4, 7, 12) THEN 1 ELSE 0 END AS versus_visible FROM decided JOIN (SELECT t, lat_i, lon_i, cls FROM classes) USING (t, lat_i, lon_i)""")
def compare_algorithms(spark, sf_dir):
    both = classify.decisions(_cube(spark, sf_dir))
    return both.select(*KEY, stats.compare(F.col("is_cloud"), F.col("is_cloud_partial")).alias("side"), stats.compare_visible(F.col("vis"), F.col("cls")).alias("versus_visible"))


_SCORED = ("gross", "transparent", "opaque")


@query(f"WITH {_INDEXED} SELECT {', '.join(f'round(count(*) FILTER ({x}) / nullif(count(*) FILTER ({" OR ".join(_SCORED)}), 0), 6) AS {x}' for x in _SCORED)} FROM decided WHERE is_land AND dawn_day")
def common_scores(spark, sf_dir):
    some = classify.with_tests(classify.with_indexes(_cube(spark, sf_dir))).filter("is_land and dawn_day")
    return stats.common_scores(some, list(_SCORED)).select(*(F.round(x, 6).alias(x) for x in _SCORED))


@query(f"WITH {_INDEXED} SELECT {', '.join(f'round(count(*) FILTER ({x} AND {" AND ".join(f"NOT {y}" for y in _SCORED if y != x)}) / nullif(count(*) FILTER ({" OR ".join(_SCORED)}), 0), 6) AS {x}' for x in _SCORED)} FROM decided WHERE is_land AND dawn_day")
def unique_scores(spark, sf_dir):
    some = classify.with_tests(classify.with_indexes(_cube(spark, sf_dir))).filter("is_land and dawn_day")
    return stats.unique_scores(some, list(_SCORED)).select(*(F.round(x, 6).alias(x) for x in _SCORED))


# neighbourhoods and segmentation ---------------------------------------------------------------------------

_BOX = """SELECT c.t, c.lat_i, c.lon_i, n.x FROM (SELECT t, lat_i, lon_i FROM cube) c, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx),
  (SELECT t, lat_i, lon_i, coalesce(vis, 0.0) AS x FROM cube) n
  WHERE n.t = c.t AND n.lat_i = least(greatest(c.lat_i + dy, 0), (SELECT side - 1 FROM grid)) AND n.lon_i = least(greatest(c.lon_i + dx, 0), (SELECT side - 1 FROM grid))"""


def _filled(spark, sf_dir) -> DataFrame:
    return _cube(spark, sf_dir).select(*KEY, "is_land", F.coalesce("vis", F.lit(0.0)).alias("x"))


@query(f"WITH b AS ({_BOX}) SELECT t, lat_i, lon_i, round(sqrt(greatest(avg(x * x) - pow(avg(x), 2), 0.0)), 5) + 0.0 AS sd, max(x) AS high, min(x) AS low FROM b GROUP BY ALL")
def local_statistics(spark, sf_dir):
    out = neighbourhood.local_std(_filled(spark, sf_dir), "x", "sd")
    out = neighbourhood.local_min(neighbourhood.local_max(out, "x", "high"), "x", "low")
    return out.select(*KEY, r("sd", 5).alias("sd"), "high", "low")


@query(f"WITH b AS ({_BOX}), s AS (SELECT t, lat_i, lon_i, sum(x) AS s FROM b GROUP BY ALL) SELECT t, lat_i, lon_i, round(coalesce(vis, 0.0) * 9 / 8 - s / 8, 9) + 0.0 AS contrast FROM cube JOIN s USING (t, lat_i, lon_i)")
def contrast(spark, sf_dir):
    return neighbourhood.contrast(_filled(spark, sf_dir), "x", "contrast").select(*KEY, r("contrast", 9).alias("contrast"))


@query(f"WITH {_INDEXED} SELECT t, lat_i, lon_i, near_land, near_land AND NOT is_land AS border FROM ix")
def dilate(spark, sf_dir):
    out = neighbourhood.dilate(_filled(spark, sf_dir), "is_land", "near_land")
    return out.select(*KEY, "near_land", (F.col("near_land") & ~F.col("is_land")).alias("border"))


@query(f"WITH b AS ({_BOX}) SELECT t, lat_i, lon_i, round(median(x), 6) AS middle FROM b GROUP BY ALL")
def median_filter(spark, sf_dir):
    return neighbourhood.median_filter(_filled(spark, sf_dir), "x", "middle", p=source.profile(spark, sf_dir)).select(*KEY, F.round("middle", 6).alias("middle"))


def _otsu(by: str) -> str:
    return f"""
WITH ok AS (SELECT {by} AS g, lir AS x FROM cube WHERE lir IS NOT NULL), span AS (SELECT g, min(x) AS lo, max(x) AS hi FROM ok GROUP BY g),
h AS (SELECT g, CAST(least(floor((x - lo) / ((hi - lo) / 256)), 255) AS INTEGER) AS bin, lo, hi, count(*) AS n FROM ok JOIN span USING (g) WHERE hi > lo GROUP BY ALL),
c AS (SELECT *, lo + (bin + 0.5) * ((hi - lo) / 256) AS c FROM h),
w AS (SELECT g, bin, c, sum(n) OVER (PARTITION BY g ORDER BY bin) AS w1, sum(n * c) OVER (PARTITION BY g ORDER BY bin) AS s1, sum(n) OVER (PARTITION BY g) AS w, sum(n * c) OVER (PARTITION BY g) AS s FROM c),
v AS (SELECT g, bin, c, round(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / (w - w1), 2), 3) AS v FROM w WHERE w > w1),
best AS (SELECT g, c FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY v DESC, bin) = 1)
SELECT g, round(c, 4) AS threshold FROM span LEFT JOIN best USING (g)"""


@query(_otsu("t"))
def otsu_per_slot(spark, sf_dir):
    return segment.otsu(_cube(spark, sf_dir), "lir", ["t"]).select(F.col("t").alias("g"), F.round("threshold", 4).alias("threshold"))


@query(_otsu("slot"))
def otsu_per_slot_of_day(spark, sf_dir):
    return segment.otsu(_cube(spark, sf_dir), "lir", ["slot"]).select(F.col("slot").alias("g"), F.round("threshold", 4).alias("threshold"))


@query("""
WITH g AS (SELECT t, lat_i, lon_i, CAST(least(floor(vis * 200), 255) AS INTEGER) AS gray FROM cube WHERE vis IS NOT NULL),
h AS (SELECT t, gray, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT t, gray, sum(n) OVER (PARTITION BY t ORDER BY gray) AS cdf, sum(n) OVER (PARTITION BY t) AS total FROM h),
d AS (SELECT *, min(cdf) OVER (PARTITION BY t) AS low FROM c)
SELECT g.t, lat_i, lon_i, gray, coalesce(CAST(floor(255.0 * (cdf - low) / nullif(total - low, 0) + 0.5) AS INTEGER), 0) AS equal FROM g JOIN d USING (t, gray)""")
def equalize_histogram(spark, sf_dir):
    gray = _cube(spark, sf_dir).filter("vis is not null").select(*KEY, F.least(F.floor(F.col("vis") * 200), F.lit(255)).cast("int").alias("gray"))
    return segment.equalize(gray, "gray", ["t"]).select(*KEY, "gray", "equal")


def _dft(keep: str) -> str:
    """Coefficients of each slot's grid by definition, weighted by `keep` (of their magnitude m), and their sum back."""
    phase = "2 * pi() * ({a}.k * {b}.lat_i + {a}.l * {b}.lon_i) / side"
    there = phase.format(a="w", b="c")
    return f"""
WITH n AS MATERIALIZED (SELECT side FROM grid),
c AS MATERIALIZED (SELECT t, lat_i, lon_i, coalesce(vis, 0.0)::DOUBLE AS x FROM cube),
w AS MATERIALIZED (SELECT lat_i AS k, lon_i AS l FROM land),
f AS MATERIALIZED (
  SELECT t, k, l, sum(x * cos({there})) AS re, -sum(x * sin({there})) AS im FROM c, w, n GROUP BY ALL
), kept AS MATERIALIZED (
  SELECT t, k, l, re * {keep} AS re, im * {keep} AS im FROM (SELECT *, sqrt(re * re + im * im) AS m FROM f)
)
SELECT w.t, c.lat_i, c.lon_i, round(sum(re * cos({there}) - im * sin({there})) / (side * side) + 1e-9, 6) + 0.0 AS smooth
FROM kept w JOIN c ON c.t = w.t, n GROUP BY w.t, c.lat_i, c.lon_i, side"""


@query(_dft("CASE WHEN m < 2.0 THEN 1 ELSE 0 END"))
def low_pass(spark, sf_dir):
    return _smoothed(spark, sf_dir, 0.0)


@query(_dft("(0.5 * (1 - sin(pi() * greatest(-0.5, least(0.5, (m - 2.0) / 2.0)))))"))
def low_pass_tapered(spark, sf_dir):
    return _smoothed(spark, sf_dir, 1.0)


def _smoothed(spark, sf_dir, width):
    p = source.profile(spark, sf_dir)
    return spectrum.low_pass(source.load_cube(spark, sf_dir, p), "vis", 2.0, (p.n_lat, p.n_lon), width).withColumn("smooth", r(F.col("smooth") + 1e-9))


@query()
def low_cut(spark, sf_dir):
    return timeseries.low_cut(_cube(spark, sf_dir), "vis").withColumn("filtered", r("filtered"))


# sun, time and sampling ------------------------------------------------------------------------------------


@query("SELECT lat_i, lon_i, dfb, arg_min(slot, (cosz, slot)) AS midnight, arg_min(slot, (-cosz, slot)) AS midday FROM cube GROUP BY ALL")
def midnight_slots(spark, sf_dir):
    return stats.darkest_slots(_cube(spark, sf_dir))


@query(f"""
WITH a AS (SELECT t, lat_i, lon_i, round(lead(cosz) OVER ({_PX}) - cosz, 9) AS rise FROM cube)
SELECT lat_i, lon_i, arg_min(t, (-rise, t)) AS sunrise, arg_min(t, (rise, t)) AS sunset FROM a WHERE rise IS NOT NULL GROUP BY ALL""")
def sunrise_slots(spark, sf_dir):
    return stats.sun_edges(_cube(spark, sf_dir))


@query("""
WITH z AS (SELECT t, round(avg(cosz), 9) AS z FROM cube GROUP BY t),
x AS (SELECT t, z, max(z) OVER (ORDER BY t ROWS BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS top FROM z),
w AS (SELECT t, CAST(t * 6 // 120 AS INTEGER) AS layer, CASE WHEN top > 0 THEN round(greatest(0.0, least(1.0, z / top)), 6) ELSE 0.0 END AS w FROM x),
s AS (SELECT layer, round(sum(w), 4) AS w, count(*) AS size FROM w GROUP BY layer),
n AS (SELECT layer, w, size, CAST(floor(30 * w / (SELECT sum(w) FROM s) + 1e-9) AS INTEGER) AS n FROM s),
m AS (SELECT layer, least(size, n + CASE WHEN layer = (SELECT layer FROM n ORDER BY w DESC, layer LIMIT 1) THEN 30 - (SELECT sum(n) FROM n) ELSE 0 END) AS n FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY (t * 7919) % 10007, t) AS rank FROM w)
SELECT t, layer FROM o JOIN m USING (layer) WHERE rank <= m.n""")
def stratified_sample(spark, sf_dir):
    zenith = _cube(spark, sf_dir).groupBy("t").agg(F.round(F.avg("cosz"), 9).alias("z"))
    return stats.stratified_slots(stats.sun_weights(zenith, "z"), F.col("w"), 0.25, 6, PROFILE.days * PROFILE.slots_per_day)


# navigation ------------------------------------------------------------------------------------------------

_LL = "SELECT c_custkey AS id, ((c_custkey * 37) % 1200) / 10.0 - 60 AS lat, ((c_custkey * 53) % 1200) / 10.0 - 60 AS lon FROM customer"
_R = navigation


def _points(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return source.read(spark, sf_dir, "customer").select(k.alias("id"), (((k * 37) % 1200) / 10.0 - 60).alias("lat"), (((k * 53) % 1200) / 10.0 - 60).alias("lon"))


_ANGLES = f"""p AS ({_LL}), q AS (SELECT *, atan({(_R.RPOL / _R.REQ) ** 2!r}::DOUBLE * tan(radians(lat))) AS pc, radians(lon - 5.0) AS lam FROM p),
r AS (SELECT *, {_R.RPOL} / sqrt(1 - {_R.E2!r}::DOUBLE * pow(cos(pc), 2)) AS rc FROM q),
s AS (SELECT *, {_R.ORBIT}::DOUBLE - rc * cos(pc) * cos(lam) AS sx, -rc * cos(pc) * sin(lam) AS sy, rc * sin(pc) AS sz FROM r),
a AS (SELECT id, lat, lon, atan(sz / sx) AS y, asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)) AS x FROM s)"""


@query(f"WITH {_ANGLES} SELECT id, round(y, 9) + 0.0 AS y, round(x, 9) + 0.0 AS x, CAST(floor((y + 0.16) / 56e-6) AS INTEGER) AS l, CAST(floor((x + 0.16) / 56e-6) AS INTEGER) AS c FROM a")
def ll_to_linecol(spark, sf_dir):
    y, x = navigation.ll_to_angles(F.col("lat"), F.col("lon"), 5.0)
    return _points(spark, sf_dir).select("id", r(y, 9).alias("y"), r(x, 9).alias("x"), navigation.angle_to_index(y, 56e-6, -0.16).alias("l"), navigation.angle_to_index(x, 56e-6, -0.16).alias("c"))


@query(f"WITH p AS ({_LL}) SELECT id, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM p")
def linecol_to_ll(spark, sf_dir):
    """The forward navigation followed by its inverse: every visible point returns to itself."""
    y, x = navigation.ll_to_angles(F.col("lat"), F.col("lon"), 5.0)
    seen = _points(spark, sf_dir).select("id", y.alias("y"), x.alias("x"))
    lat, lon = navigation.angles_to_ll(F.col("y"), F.col("x"), 5.0)
    return seen.select("id", r(lat).alias("lat"), r(lon).alias("lon"))


@query(f"""WITH {_ANGLES}, k AS (SELECT id, CAST(floor((y + 0.16) / 0.02) AS INTEGER) AS l, CAST(floor((x + 0.16) / 0.02) AS INTEGER) AS c FROM a)
SELECT id, l, c, CASE WHEN l BETWEEN 0 AND 15 AND c BETWEEN 0 AND 15 THEN CAST(l * 100.0 + c AS DOUBLE) END AS v FROM k""")
def reproject_nearest(spark, sf_dir):
    i = F.col("id")
    raster = spark.range(256).select(F.floor(i / 16).cast("int").alias("l"), (i % 16).cast("int").alias("c"), (F.floor(i / 16) * 100.0 + i % 16).alias("v"))
    return navigation.reproject(raster, _points(spark, sf_dir), 5.0, 0.02, -0.16).select("id", "l", "c", "v")


@query(f"""WITH p AS ({_LL}), q AS (SELECT id, CASE WHEN lat % 5 = 0 THEN lat - 1 ELSE lat END AS lat, CASE WHEN lon % 5 = 0 THEN lon + 1 ELSE lon END AS lon FROM p),
k AS (SELECT id, CAST(ceil((90 - lat) / 5) - 1 AS INTEGER) AS tile_r, CAST(ceil((180 + lon) / 5) - 1 AS INTEGER) AS tile_c FROM q)
SELECT id, tile_r, tile_c, CAST(90 - 5 * (1 + tile_r) AS DOUBLE) AS lat0, CAST(-180 + 5 * tile_c AS DOUBLE) AS lon0 FROM k""")
def tile_rc(spark, sf_dir):
    row, col = navigation.tile_of(F.col("lat"), F.col("lon"))
    lat0, lon0 = navigation.tile_corner(F.col("tile_r"), F.col("tile_c"))
    return _points(spark, sf_dir).select("id", row.alias("tile_r"), col.alias("tile_c")).withColumn("lat0", lat0).withColumn("lon0", lon0)


@query("SELECT s_suppkey AS id, (s_suppkey % 6) + (s_nationkey % 6) * 6 + ((s_suppkey // 6) % 6) * 36 AS code, s_suppkey % 6 AS d0, CAST(s_nationkey % 6 AS BIGINT) AS d1, (s_suppkey // 6) % 6 AS d2 FROM supplier")
def label_encode(spark, sf_dir):
    k = F.col("s_suppkey")
    digits = F.array(k % 6, F.col("s_nationkey").cast("long") % 6, F.floor(k / 6).cast("long") % 6)
    coded = source.read(spark, sf_dir, "supplier").select(k.alias("id"), navigation.encode_labels(digits).alias("code"))
    back = navigation.decode_labels(F.col("code"), 3)
    return coded.select("id", "code", *(back[i].alias(f"d{i}") for i in range(3)))


# labels and models -----------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(quality, -10) AS label FROM documents LEFT JOIN labels USING (doc_id)")
def labels_keep_holes(spark, sf_dir):
    docs = source.read(spark, sf_dir, "documents").select("doc_id")
    return docs.join(source.read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-10)).alias("label"))


@query("SELECT doc_id, quality AS label FROM documents JOIN labels USING (doc_id)")
def labels_remove_holes(spark, sf_dir):
    docs = source.read(spark, sf_dir, "documents").select("doc_id")
    return docs.join(source.read(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").alias("label"))


@query("SELECT vec_id, label FROM embeddings WHERE label NOT IN (0, 3)")
def drop_labels(spark, sf_dir):
    return source.read(spark, sf_dir, "embeddings").filter(~F.col("label").isin(0, 3)).select("vec_id", "label")


@query("""
WITH l AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings),
m AS (SELECT label AS candidate, dim, avg(x::DOUBLE) AS m FROM l GROUP BY ALL),
d AS (SELECT vec_id, label, candidate, round(sum(pow(x::DOUBLE - m, 2)), 6) AS d FROM l JOIN m USING (dim) GROUP BY ALL)
SELECT vec_id, label, arg_min(candidate, (d, candidate)) AS predicted FROM d GROUP BY ALL""")
def centroid_vote(spark, sf_dir):
    return models.centroid_vote(source.read(spark, sf_dir, "embeddings"))


@query()
def kmeans(spark, sf_dir):
    return models.cluster(source.read(spark, sf_dir, "embeddings"), 10)


@query()
def pca(spark, sf_dir):
    return models.project(source.read(spark, sf_dir, "embeddings"))


@query()
def gmm_covertness(spark, sf_dir):
    return models.covertness(classify.with_indexes(_cube(spark, sf_dir)).select(*KEY, "cli"), "cli").select(*KEY, "grade")


@query()
def random_forest(spark, sf_dir):
    return models.classify(source.read(spark, sf_dir, "embeddings"), "forest")


@query()
def entropy_tree(spark, sf_dir):
    return models.classify(source.read(spark, sf_dir, "embeddings"), "tree")


@query()
def gaussian_bayes(spark, sf_dir):
    return models.classify(source.read(spark, sf_dir, "embeddings"), "bayes")


@query()
def perceptron(spark, sf_dir):
    return models.classify(source.read(spark, sf_dir, "embeddings"), "perceptron")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return static_classifier(spark, sf_dir)


from . import catalog_angles, catalog_grids, catalog_more, catalog_rules, catalog_tiles  # noqa: E402, F401  (register their queries)
