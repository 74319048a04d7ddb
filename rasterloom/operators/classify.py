"""Indexes, per-pixel tests and class codes of the static classifier, and operators on class codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Profile, Thresholds
from ..functions import physics as P
from . import neighbourhood, segment, stats, tiles, timeseries

TH = Thresholds()


def with_indexes(cube: DataFrame) -> DataFrame:
    """Adds cli, cli_mu, cli_eps (on lir and fir), ndsi, and forecast brightness temperatures."""
    mir, lir, fir, vis, sir = (F.col(c) for c in ("mir", "lir", "fir", "vis", "sir"))
    return cube.withColumns({
        "cli": P.cloud_index(F.col("cosz"), mir, lir),
        "cli_mu": P.cloud_index(F.col("cosz"), mir, lir, "mu-normalization"),
        "cli_eps": P.cloud_index(F.col("cosz"), lir, fir, "epsilon"),
        "ndsi": P.snow_index(vis, sir),
        "lir_fc": P.brightness_temperature(F.col("t2m"), 10.4e-6, 0.95),
        "fir_fc": P.brightness_temperature(F.col("t2m"), 12.4e-6, 0.95),
    })


def _near_land(cube: DataFrame) -> DataFrame:
    """The cube with near_land: as it was loaded, else from its own cells."""
    return cube if "near_land" in cube.columns else neighbourhood.dilate_fixed(cube, "is_land", "near_land")


def with_tests(cube: DataFrame, exhaustive: bool = True) -> DataFrame:
    """Adds the single tests and the cloud and snow decisions (`is_cloud`, `is_snow`; of the other variant `is_cloud_partial`, `is_snow_partial`)."""
    lir, fir, vis, land = F.col("lir"), F.col("fir"), F.col("vis"), F.col("is_land")
    cube = _near_land(cube)
    cube = cube.withColumns({
        "variability": timeseries.positive_variability(F.col("cli")),
        "dawn_day": P.gate(F.col("zen"), "dawn_day"),
        "gross": P.gross_cloud(lir, F.col("lir_fc")),
        "opaque": P.opaque_cloud(F.col("cli_mu"), F.col("cli_eps")),
        "transparent": P.transparent_cloud(F.col("cli_eps")),
        "cirrus": P.thin_cirrus(land, lir, fir, F.col("lir_fc"), F.col("fir_fc")),
        "sea_coast": P.sea_coast_cloud(F.col("zen"), land, F.col("near_land"), vis),
        "bright": P.test(vis > TH.vis_snow),
    })
    snowy = F.col("dawn_day") & land & P.ndsi_test(F.col("ndsi")) & P.test(F.col("cli_mu") < TH.cli_snow) & F.col("bright")
    whole = F.col("opaque") | F.col("transparent") | F.col("sea_coast") | F.col("gross") | F.col("cirrus")
    unstable = P.test((F.col("cli_mu") > TH.cli_cloud) & (F.col("variability") > TH.stability))
    both = {
        "": (F.col("dawn_day") & whole, snowy & P.gross_snow(lir, F.col("lir_fc")) & P.broad_cirrus_snow(F.col("cli_eps"))),
        "_partial": (F.col("dawn_day") & (unstable | F.col("sea_coast") | F.col("gross")), snowy),
    }
    cube = cube.withColumns({f"is_{k}{v}": both[v][i] for v in both for i, k in enumerate(("cloud", "snow"))})
    return cube if exhaustive else cube.withColumns({f"is_{k}": F.col(f"is_{k}_partial") for k in ("cloud", "snow")})


def _early(cube: DataFrame, exhaustive: bool, maybe_snow: str | None = None) -> DataFrame:
    """Adds `early`, the class before the late tests, `suspect`, `background` and `late`; where the column `maybe_snow` holds nothing is free."""
    cube = with_tests(with_indexes(cube), exhaustive)
    invalid = F.col("vis").isNull() | F.col("sir").isNull() | F.col("mir").isNull() | F.col("lir").isNull()
    ndsi = F.col("ndsi")
    change = F.abs(timeseries.step_variability(ndsi))
    suspect = F.col("is_snow") & P.test((timeseries.positive_variability(ndsi) > 0.2) | (timeseries.negative_variability(ndsi) > 0.2) | ((change > 0.05) & (change < 10)))
    free = F.col("early") == 0
    if maybe_snow is not None:
        free = free & ~F.coalesce(maybe_snow, F.lit(False))
    early = F.when(F.col("is_cloud"), 2).when(invalid | ~F.col("dawn_day"), 5).when(F.col("is_snow"), 1).otherwise(0)
    cube = late_background(cube.withColumn("suspect", suspect).withColumn("early", early).withColumn("free", free), "vis", "free")
    return cube.withColumn("late", F.col("is_land") & late_cloud(F.col("vis"), F.col("free"), F.col("background")))


def _with_class(cube: DataFrame, exhaustive: bool, maybe_snow: str | None = None) -> DataFrame:
    cls = F.when(F.col("late"), 4).when(F.col("suspect") & (F.col("early") == 1), 3).otherwise(F.col("early"))
    return _early(cube, exhaustive, maybe_snow).withColumn("cls", cls.cast("int"))


def classify(cube: DataFrame, p: Profile = Profile(), exhaustive: bool = True) -> DataFrame:
    """t, lat_i, lon_i, cls: 0 clear, 1 snow, 2 cloud, 3 suspect snow, 4 cloud seen late, 5 undefined."""
    return _with_class(cube, exhaustive).select("t", "dfb", "slot", "lat_i", "lon_i", "cls", "vis", "cosz", "is_land")


def classify_broad(cube: DataFrame, broad: DataFrame | None = None) -> DataFrame:
    """t, lat_i, lon_i, cls as by `classify`, but what may be snow by the broad test (`broad` of broad_snow, unless given)
    is not cloud-free for the late test, neither as itself nor as a neighbour in time or a background."""
    broad = broad_snow(with_indexes(cube)) if broad is None else broad
    joined = cube.join(broad.select(*tiles.KEY, F.col("broad").alias("_broad")), list(tiles.KEY), "left")
    return _with_class(joined, True, "_broad").select(*tiles.KEY, "cls")


def decisions(cube: DataFrame) -> DataFrame:
    """t, lat_i, lon_i, vis, cls and both variants' cloud decisions, from one pass over the cube."""
    return _with_class(cube, True).select("t", "lat_i", "lon_i", "vis", "cls", "is_cloud", "is_cloud_partial")


def unstable_albedo(cube: DataFrame) -> DataFrame:
    """t, lat_i, lon_i, background, unstable: cloud-free land brighter than its background."""
    return _early(cube, True).select("t", "lat_i", "lon_i", "background", F.col("late").alias("unstable"))


def late_background(cube: DataFrame, vis: str, free: str) -> DataFrame:
    """Adds `background`: the least trailing mean over 5 slots of the same slot and cell, in which a view counts
    if the cell is cloud-free there and one and two slots before and after (past the ends: not free), else as 100."""
    long = F.col(free)
    for k in (1, 2):
        long = long & F.coalesce(F.lag(free, k).over(timeseries.by_time()), F.lit(False)) & F.coalesce(F.lead(free, k).over(timeseries.by_time()), F.lit(False))
    cube = cube.withColumn("steady", F.when(long, F.col(vis)).otherwise(100.0)).withColumn("smooth", timeseries.rolling_mean(F.col("steady"), 5))
    return cube.withColumn("background", F.min("smooth").over(Window.partitionBy("lat_i", "lon_i", "slot"))).drop("steady", "smooth")


def late_cloud(vis: Column, free: Column, background: Column, limit: float = TH.land_visible) -> Column:
    """Cloud-free and brighter than the background of late_background."""
    return P.test(free & (vis - background > limit))


def thick_cloud(cube: DataFrame, quick: bool = False) -> DataFrame:
    """Adds `thick`: opaque cloud; unless `quick`, also an uneven brightness temperature (3x3 deviation over TH.texture)
    that rises (deviation's largest rise over near days above 0.2) or is opaque, and opaque only where bright (vis > 0.5).
    Needs cli_mu and cli_eps of with_indexes."""
    opaque = P.opaque_cloud(F.col("cli_mu"), F.col("cli_eps"))
    if quick:
        return cube.withColumn("thick", opaque)
    cube = neighbourhood.local_std(cube.withColumn("_x", F.coalesce("lir", F.lit(0.0))), "_x", "texture").withColumn("texture", F.round("texture", 4))
    cube = cube.withColumn("_rise", timeseries.positive_variability(F.col("texture")))
    uneven = F.col("texture") > TH.texture
    return cube.withColumn("thick", (uneven & (F.col("_rise") > 0.2)) | (uneven & opaque) | (opaque & P.test(F.col("vis") > 0.5))).drop("_x", "_rise")


def broad_snow(cube: DataFrame, size: tuple[int, int, int] = tiles.SIZE) -> DataFrame:
    """t, lat_i, lon_i, broad: day or dawn, land, bright by the broad limit, and over the plain snow index test or on the rim
    of what lies under the broad limit, through space and time (tiles.watershed_volume).  Needs ndsi of with_indexes."""
    ndsi = F.col("ndsi")
    rest = P.gate(F.col("zen"), "dawn_day") & F.col("is_land") & P.test(F.col("vis") > TH.broad_vis_snow)
    kept = cube.select(*tiles.KEY, P.test(ndsi < TH.broad_ndsi).alias("under"), P.ndsi_test(ndsi).alias("over"), rest.alias("rest"))
    rim = tiles.watershed_volume(kept, "under", size=size)
    return kept.join(rim, list(tiles.KEY)).select(*tiles.KEY, (F.col("rest") & (F.col("rim") | F.col("over"))).alias("broad"))


def features(cube: DataFrame, kind: str, level: str, p: Profile = Profile()) -> DataFrame:
    """The features of a kind (infrared or visible) at a level (channel, cli, ndsi, abstract); other names are refused."""
    key = ["t", "lat_i", "lon_i"]
    channels = {"infrared": ("fir", "lir", "mir"), "visible": ("sir", "vis")}
    if kind not in channels or level not in ("channel", "abstract", {"infrared": "cli", "visible": "ndsi"}[kind]):
        raise ValueError(f"no {level} features of kind {kind}")
    if level == "channel":
        return cube.select(*key, *channels[kind])
    cube = with_indexes(cube)
    if level in ("cli", "ndsi"):
        return cube.select(*key, level)
    if kind == "visible":
        cube = _near_land(cube)
        masked = ~P.gate(F.col("zen"), "dawn_day") | F.col("vis").isNull() | F.col("sir").isNull() | ~F.col("is_land")
        cube = cube.withColumn("shown", F.when(~masked, F.col("ndsi")))
        shown = F.col("shown")
        sea = P.sea_coast_cloud(F.col("zen"), F.col("is_land"), F.col("near_land"), F.col("vis"))
        return cube.select(
            *key, F.coalesce(shown, F.lit(timeseries.FILL)).alias("ndsi"), timeseries.negative_variability(shown).alias("drop"),
            timeseries.lasting_rise(shown, p.first_day, p.last_day).alias("rise"), sea.cast("int").alias("sea"),
        )
    lit = P.gate(F.col("zen"), "dawn_day")
    cold = (lit & P.cold(F.col("lir"), F.col("t2m"))).cast("int")
    return cube.select(*key, "cli_eps", timeseries.positive_variability(F.col("cli")).alias("cli_variability"), F.col("cli").alias("difference"), cold.alias("cold"))


def cloud_shade(classes: DataFrame, limit: float = 0.2) -> DataFrame:
    """Adds `shade`: cloud-free and darker than the cell's usual cloud-free view of that slot."""
    free = F.col("cls").isin(0, 1)
    usual = F.median(F.when(free, F.col("vis"))).over(Window.partitionBy("lat_i", "lon_i", "slot"))
    return classes.withColumn("shade", P.test(free & (usual - F.col("vis") > limit * F.col("cosz"))))


def with_shades(cube: DataFrame, limit: float = 0.2) -> DataFrame:
    """cls becomes 11 where a tree's codes are cloud-free (0 or 5) and darker than the cell's usual cloud-free view of that slot; needs vis and cosz."""
    free = F.col("cls").isin(0, 5)
    usual = F.median(F.when(free, F.col("vis"))).over(Window.partitionBy("lat_i", "lon_i", "slot"))
    return cube.withColumn("cls", F.when(P.test(free & (usual - F.col("vis") > limit * F.col("cosz"))), 11).otherwise(F.col("cls")))


def reduce_classes(cls: Column) -> Column:
    """0 clear, 1 snow, 2 slight cloud, 3 cloud, 4 undefined; clear only between clear neighbours in time."""
    clear = cls.isin(0, 5, 9, 10)
    alone = clear & F.coalesce(F.lag(clear).over(timeseries.by_time()), F.lit(True)) & F.coalesce(F.lead(clear).over(timeseries.by_time()), F.lit(True))
    return F.when(alone & (cls == 5), 1).when(alone, 0).when(cls.isin(2, 4), 2).when(cls == 13, 4).otherwise(3)


def reduce_two_classes(cls: Column) -> Column:
    return F.when(cls.isin(0, 1), 0).otherwise(1)


def tree_codes(cube: DataFrame) -> DataFrame:
    """t, lat_i, lon_i, cls of the decision tree: later rules of the written order win, so they come first here."""
    vis, ndsi, cli = F.col("vis"), F.col("ndsi"), F.col("cli_eps")
    invalid = F.col("vis").isNull() | F.col("lir").isNull() | F.col("mir").isNull()
    cold = P.cold(F.col("lir"), F.col("t2m"))
    slight, obvious = P.test(cli > 0.1), P.test(cli > TH.cloud_epsilon)
    bright, snow = P.test(vis > TH.vis_snow), P.test(ndsi > TH.ndsi)
    varies = P.test(timeseries.positive_variability(vis) > 0.2)
    cls = (
        F.when(cold, 8).when(bright & ~snow & varies & slight, 2).when(obvious, 1).when(snow & varies, 7).when(snow & slight, 6)
        .when(snow & bright & F.col("is_land"), 5).when(~F.col("is_land") & bright, 12).when(invalid | ~P.gate(F.col("zen"), "dawn_day"), 13).when(bright, 3).otherwise(0)
    )
    return with_indexes(cube).select("t", "dfb", "slot", "lat_i", "lon_i", cls.cast("int").alias("cls"))


def point_codes(cube: DataFrame, p: Profile = Profile(), shades: bool = True, bright: DataFrame | None = None, size: tuple[int, int, int] = tiles.SIZE) -> DataFrame:
    """t, lat_i, lon_i, cls: 1 obvious and 2 thin cloud, 3 seen but undecided, 5 snow, 6 and 7 bright that rises or falls, 8 cold, 11 shade,
    12 cloud over sea, 13 undefined, 0 else; later rules of the written order win, so they come first here.

    Bright is the rim of what lies under the snow limit, through space and time
    (tiles.watershed_volume), unless `bright` (key and `bright`) is given.
    """
    key = list(tiles.KEY)
    cube = with_indexes(cube)
    seen = features(cube, "visible", "abstract", p).select(*key, F.col("ndsi").alias("f_ndsi"), "drop", "rise", "sea")
    cube = cube.join(seen, key).withColumns({"thin": P.test(F.col("cli_eps") > 0.2), "turbulent": P.test(timeseries.positive_variability(F.col("cli")) > 10), "frost": P.gate(F.col("zen"), "dawn_day") & P.cold(F.col("lir"), F.col("t2m"))})
    if bright is None:
        kept = cube.select(*key, (F.col("f_ndsi") < TH.ndsi).alias("under"))
        bright = tiles.watershed_volume(kept, "under", size=size).select(*key, F.col("rim").alias("bright"))
    cube = cube.join(bright.select(*key, F.col("bright").alias("_bright")), key, "left").withColumn("_bright", F.coalesce("_bright", F.lit(False)))
    falls, rises = F.col("_bright") & (F.col("drop") > 0.2), F.col("_bright") & (F.col("rise") > 0.2)
    undecided = P.test((F.col("vis") > 0.5 * F.col("zen")) & (F.col("sir") > 0.1 * F.col("zen")))
    unknown = F.col("cli_eps").isNull()
    cls = (
        F.when(F.col("frost"), 8).when(F.col("thin"), 2).when(F.col("turbulent"), 1).when(falls, 7).when(rises, 6).when(F.col("_bright"), 5)
        .when(F.col("sea") == 1, 12).when(unknown, 13).when(undecided, 3).otherwise(0)
    )
    cube = cube.withColumn("cls", cls.cast("int"))
    cube = with_shades(cube) if shades else cube
    return cube.select(*key, "cls")


def broken_cloud(cube: DataFrame) -> DataFrame:
    """Adds `broken`: opaque cloud by the epsilon and mu indexes that was not opaque so lately: its 0 or 1 rises over the near days by more than TH.texture_rise.

    The limit lies above 1, so the test holds nowhere; a column `thickness` in place of 0 and 1 makes it tell.  Needs cli_mu and cli_eps of with_indexes."""
    opaque = P.opaque_cloud(F.col("cli_mu"), F.col("cli_eps"))
    size = F.col("thickness") if "thickness" in cube.columns else opaque.cast("double")
    return cube.withColumn("broken", opaque & P.test(timeseries.positive_variability(size) > TH.texture_rise))


def segmentation_codes(cube: DataFrame, shades: bool = False) -> DataFrame:
    """t, lat_i, lon_i, cls of the tree that thresholds gray-scale features by Otsu in each slot, with `shades` as 11; later rules of the written order win, so they come first here."""
    lit = P.gate(F.col("zen"), "dawn_day")
    cube = _near_land(with_indexes(cube)).withColumns({
        "rises": timeseries.positive_variability(F.col("ndsi")), "falls": timeseries.negative_variability(F.col("ndsi")),
        "sea": P.sea_coast_cloud(F.col("zen"), F.col("is_land"), F.col("near_land"), F.col("vis")), "cold": lit & P.cold(F.col("lir"), F.col("t2m")),
    })
    kinds = ("ndsi", "vis", "cli_eps")
    cube = stats.gray_scaled(cube, {f"g_{x}": x for x in (*kinds, "rises", "falls", "cli")})
    long = cube.select("t", F.explode(F.array(*(F.struct(F.lit(x).alias("kind"), F.col(f"g_{x}").alias("x")) for x in kinds))).alias("f")).select("t", "f.*")
    limits = segment.otsu(long, "x", ["t", "kind"]).groupBy("t").pivot("kind", list(kinds)).agg(F.first("threshold"))
    cube = cube.join(limits.select("t", *(F.col(x).alias(f"l_{x}") for x in kinds)), "t", "left")
    above = {x: P.test(F.col(f"g_{x}") > F.col(f"l_{x}")) for x in kinds}
    bright, obvious = above["ndsi"] & above["vis"], above["cli_eps"] & (F.col("g_cli") > 20)
    rises, falls = F.col("g_rises") > 30, F.col("g_falls") > 30
    invalid = F.col("mir").isNull() | F.col("lir").isNull() | F.col("fir").isNull()
    cls = (
        F.when(obvious & bright, 3).when(obvious, 1).when(F.col("cold"), 8).when(bright & falls, 7).when(bright & rises, 6)
        .when(bright, 5).when(F.col("sea"), 12).when(invalid, 13).otherwise(0)
    )
    cube = cube.withColumn("cls", cls.cast("int"))
    return (with_shades(cube) if shades else cube).select("t", "lat_i", "lon_i", "cls")


def warm_ground(cube: DataFrame, cloudy: str, limit: float, minutes: int = 240, p: Profile = Profile()) -> DataFrame:
    """Adds `warm`: on that day the median of the cell's cloud-free mir, from noon for `minutes`, lies above the limit (none: false)."""
    noon = p.slots_per_day // 2
    around = F.col("slot").between(noon, noon + minutes // (60 * p.hours_per_slot)) & ~F.col(cloudy)
    median = F.median(F.when(around, F.col("mir"))).over(Window.partitionBy("lat_i", "lon_i", "dfb"))
    return cube.withColumn("warm", P.test(median > limit))
