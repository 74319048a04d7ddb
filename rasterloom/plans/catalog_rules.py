"""More of the query catalogue: visible features, broad snow, sun followers, chained midnights, clusters, label files, ensembles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import classify, density, ensembles, mixtures, patterns
from ..sources import cube as source
from ..sources import slot_files, storage
from .catalog import _DAY, _INDEXED, _SLICED, KEY, PROFILE, _cube, _test, query, r

_LAGS = [f"{f}(shown, {k}) OVER ({_DAY})" for f in ("lag", "lead") for k in (1, 2)]
_IN_RANGE = ["dfb - 1 >= 16071", "dfb - 2 >= 16071", "dfb + 1 <= 16100", "dfb + 2 <= 16100"]


@query(f"""
WITH {_INDEXED},
m AS (
  SELECT *, CASE WHEN dawn_day AND vis IS NOT NULL AND sir IS NOT NULL AND is_land THEN ndsi END AS shown
  FROM tested
), v AS (
  SELECT t, lat_i, lon_i, shown, sea_coast,
    greatest(0.0, {", ".join(f"{y} - shown" for y in _LAGS)}) AS falls_most,
    greatest(0.0, least({", ".join(f"CASE WHEN {ok} THEN coalesce(shown - {y}, -10.0) END" for y, ok in zip(_LAGS, _IN_RANGE, strict=True))})) AS rises_least
  FROM m
)
SELECT t, lat_i, lon_i, round(coalesce(shown, -10.0), 6) + 0.0 AS ndsi, round(falls_most, 6) + 0.0 AS "drop", round(rises_least, 6) + 0.0 AS rise,
  CAST(sea_coast AS INTEGER) AS sea
FROM v""")
def visible_features(spark, sf_dir):
    out = classify.features(_cube(spark, sf_dir), "visible", "abstract", PROFILE)
    return out.select(*KEY, r("ndsi").alias("ndsi"), r("drop").alias("drop"), r("rise").alias("rise"), "sea")


@query()
def broad_snow(spark, sf_dir):
    """With the rim of a watershed through space and time; held against a plain version in the tests."""
    return classify.broad_snow(classify.with_indexes(_cube(spark, sf_dir)))


# Student's t with whole degrees of freedom as finite sums of powers of the cosine: another way to the p-value
_P = """
1 - CASE
  WHEN n % 2 = 0 THEN abs({r}) * list_sum(list_transform(range((n - 2) // 2),
    lambda k: list_reduce(range(1, k + 1), lambda d, i: d * (2 * i - 1) / (2 * i), 1.0::DOUBLE) * pow(1 - {r} * {r}, k)))
  ELSE 2 / pi() * (asin(abs({r})) + abs({r}) * list_sum(list_transform(range((n - 3) // 2),
    lambda k: list_reduce(range(1, k + 1), lambda d, i: d * (2 * i) / (2 * i + 1), 1.0::DOUBLE) * pow(sqrt(1 - {r} * {r}), 2 * k + 1))))
END"""


@query(f"""
WITH {_SLICED},
x AS (SELECT *, (vis - sir) / greatest(sir + vis, 0.02) AS ndsi FROM sliced),
s AS (
  SELECT lat_i, lon_i, slice, count(*) AS n,
    covar_pop(cosz, vis) / (stddev_pop(cosz) * stddev_pop(vis)) AS r_vis,
    covar_pop(cosz, sir) / (stddev_pop(cosz) * stddev_pop(sir)) AS r_sir
  FROM x WHERE ndsi IS NOT NULL GROUP BY ALL HAVING count(*) > 12
), p AS (SELECT *, {_P.format(r="r_vis")} AS p_vis, {_P.format(r="r_sir")} AS p_sir FROM s)
SELECT t, x.lat_i, x.lon_i, x.slice, round(r_vis, 6) + 0.0 AS r_vis, round(p_vis, 6) + 0.0 AS p_vis, round(r_sir, 6) + 0.0 AS r_sir, round(p_sir, 6) + 0.0 AS p_sir,
  round(CASE WHEN {_test("r_vis > 0.6 AND r_sir < 1.6")} THEN ndsi / nullif(cosz, 0) ELSE ndsi END, 6) + 0.0 AS ndsi
FROM x LEFT JOIN p USING (lat_i, lon_i, slice)""")
def pattern_vis(spark, sf_dir):
    sliced = patterns.with_slices(classify.with_indexes(_cube(spark, sf_dir)), 40, PROFILE.first_day)
    out = patterns.sun_followers(sliced, "vis", "sir", "ndsi", "cosz", 0.4)
    rounded = {"ndsi": "index_out"} | {c: c for c in ("r_vis", "p_vis", "r_sir", "p_sir")}
    return out.select(*KEY, "slice", *(r(c).alias(name) for name, c in rounded.items()))


def _chain(best: str) -> str:
    return f"""
WITH RECURSIVE sun AS MATERIALIZED (SELECT lat_i, lon_i, t, cosz FROM cube),
cells AS MATERIALIZED (SELECT lat_i, lon_i, max(t) AS last FROM sun GROUP BY ALL),
chain AS (
  SELECT lat_i, lon_i, last, 0 AS k, 0 AS t FROM cells
  UNION ALL
  SELECT c.lat_i, c.lon_i, any_value(c.last), c.k + 1, {best}
  FROM chain c JOIN sun s ON s.lat_i = c.lat_i AND s.lon_i = c.lon_i AND s.t >= c.t + 1 AND s.t < c.t + 7
  GROUP BY c.lat_i, c.lon_i, c.k
)
SELECT lat_i, lon_i, k, t FROM chain WHERE k > 0"""


@query(_chain("arg_min(s.t, (s.cosz, s.t))"))
def midnight_chain(spark, sf_dir):
    return patterns.next_extremes(_cube(spark, sf_dir), PROFILE.slots_per_day)


@query(_chain("arg_min(s.t, (-s.cosz, s.t))"))
def midday_chain(spark, sf_dir):
    return patterns.next_extremes(_cube(spark, sf_dir), PROFILE.slots_per_day, midday=True)


@query("""
WITH RECURSIVE e AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings),
near AS (SELECT p.vec_id AS x, q.vec_id AS y FROM e p JOIN e q ON pow(p.a - q.a, 2) + pow(p.b - q.b, 2) + pow(p.c - q.c, 2) <= 0.05::DOUBLE * 0.05::DOUBLE),
core AS (SELECT x FROM near GROUP BY x HAVING count(*) >= 5),
link AS (SELECT near.x, near.y FROM near JOIN core a ON a.x = near.x JOIN core b ON b.x = near.y),
reach AS (SELECT x, x AS y FROM core UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y),
named AS (SELECT x, min(y) AS cluster FROM reach GROUP BY x),
border AS (SELECT near.x, min(cluster) AS cluster FROM near JOIN named ON named.x = near.y GROUP BY near.x)
SELECT vec_id, core.x IS NOT NULL AS is_core, coalesce(named.cluster, border.cluster) AS cluster
FROM e LEFT JOIN core ON core.x = vec_id LEFT JOIN named ON named.x = vec_id LEFT JOIN border ON border.x = vec_id""")
def density_clusters(spark, sf_dir):
    """DBSCAN over three components of the embeddings."""
    x = F.col("embedding")
    points = source.read(spark, sf_dir, "embeddings").select("vec_id", *(x[i].cast("double").alias(c) for i, c in enumerate("abc")))
    return density.clusters(points, "vec_id", ["a", "b", "c"], 0.05, 5)


@query()
def bayesian_mixture(spark, sf_dir):
    """A variational mixture of at most six Gaussians over three components of the embeddings; held against a plain version in the tests."""
    x = F.col("embedding")
    points = source.read(spark, sf_dir, "embeddings").select("vec_id", *(x[i].cast("double").alias(c) for i, c in enumerate("abc")))
    return mixtures.assign(points, "vec_id", ["a", "b", "c"], mixtures.fit(points, ["a", "b", "c"], 6, steps=40)).withColumn("share", r("share", 4))


def _written_labels(spark, sf_dir, kind, label):
    """A fresh folder of label files made from the cube: every slot but each seventh."""
    p = source.profile(spark, sf_dir)
    labels = source.scan_channels(spark, sf_dir, p).filter("t % 7 <> 3").select("dfb", "slot", "lat_i", "lon_i", label.alias("label"))
    path = f"{storage.shared_dir(spark)}/slot-files/{uuid.uuid4().hex}"
    slot_files.write_slots(labels, path, kind, p.slots_per_day, (p.n_lat, p.n_lon)).count()
    return path, p


@query("""
WITH l AS (SELECT t, lat_i, lon_i, round(least(vis, 1.0), 6) AS label FROM obs WHERE t % 7 <> 3)
SELECT c.t, c.dfb, c.slot, c.lat_i, c.lon_i, coalesce(label, -10.0) AS label
FROM cube c LEFT JOIN l USING (t, lat_i, lon_i) WHERE c.dfb BETWEEN 16075 AND 16090 AND c.slot >= 1""")
def slot_labels_with_holes(spark, sf_dir):
    """Files by slot, written and read back by day and slot; missing slots and cells as holes."""
    path, p = _written_labels(spark, sf_dir, "CSP", F.round(F.least("vis", F.lit(1.0)), 6))
    read = slot_files.read_slots(spark, path, p.first_day, p.last_day, kind="CSP", window=f"0,{p.n_lat},0,{p.n_lon}")
    return read.filter("dfb between 16075 and 16090 and slot >= 1")


@query("""
WITH l AS (SELECT t, lat_i, lon_i, floor(vis * 4) AS label FROM obs WHERE t % 7 <> 3), s AS (SELECT DISTINCT t FROM l)
SELECT c.t, c.lat_i, c.lon_i, label, CASE WHEN label = 2 THEN 0 ELSE 1 END AS reduced
FROM cube c SEMI JOIN s USING (t) LEFT JOIN l USING (t, lat_i, lon_i)""")
def foreign_classes(spark, sf_dir):
    """Another algorithm's classes by slot file: missing ones are null, slots without a file left out."""
    path, p = _written_labels(spark, sf_dir, "CLS", F.floor(F.col("vis") * 4).cast("double"))
    read = slot_files.read_slots(spark, path, p.first_day, p.last_day, kind="CLS", holes="remove")
    return read.select(*KEY, "label", slot_files.reduce_foreign(F.col("label")).alias("reduced"))


def _quadrants(spark, sf_dir):
    """The first eight components of the embeddings, and which quadrant the first two lie in."""
    x = F.col("embedding").cast("array<double>")
    return source.read(spark, sf_dir, "embeddings").select("vec_id", F.slice(x, 1, 8).alias("x"), (F.when(x[0] > 0, 2).otherwise(0) + F.when(x[1] > 0, 1).otherwise(0)).alias("cls"))


_EMBEDDED = "e AS (SELECT vec_id, CAST(embedding[1:8] AS DOUBLE[]) AS x, CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS cls FROM embeddings)"


def _number(number: str) -> str:
    return f"('0x' || substr(md5(vec_id || ':' || {number}), 1, 8))::BIGINT"


def _scored(by: str, fits: str) -> str:
    """Classes of largest likelihood: long rows l (vec_id, by, cls, k, x, w) are learned from, q (vec_id, by, k, x) are judged."""
    return f"""m AS (
  SELECT {by}, cls, k, sum(w) AS total, sum(w * x) / sum(w) AS mean, sum(w * x * x) / sum(w) AS square FROM ({fits}) GROUP BY ALL
), v AS (
  SELECT *, greatest(square - mean * mean, 0.0) AS raw FROM m
), s AS (
  SELECT *, raw + 1e-9 * greatest(1.0, max(raw) OVER (PARTITION BY {by})) AS var FROM v
), prior AS (
  SELECT {by}, cls, ln(total / sum(total) OVER (PARTITION BY {by})) AS lp FROM m WHERE k = 1
), score AS (
  SELECT q.vec_id, {by}, s.cls, any_value(lp) - 0.5 * sum(ln(2 * pi() * var) + pow(q.x - mean, 2) / var) AS score
  FROM q JOIN s USING ({by}, k) JOIN prior USING ({by}, cls) GROUP BY ALL
), vote AS (SELECT vec_id, {by}, arg_max(cls, (score, -cls)) AS vote FROM score GROUP BY ALL)"""


_DRAWN = " + ".join(f"CASE WHEN u >= {least} THEN 1 ELSE 0 END" for least in ensembles.poisson_steps())


@query(f"""
WITH {_EMBEDDED},
drawn AS (SELECT *, {_DRAWN} AS w FROM (SELECT vec_id, cls, x, r, {_number("r")} AS u FROM e, range(10) t(r))),
long AS (SELECT vec_id, r, cls, w, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM drawn),
q AS (SELECT vec_id, r, k, x FROM long),
{_scored("r", "SELECT * FROM long WHERE w > 0")},
every AS (SELECT vec_id, vote, count(*) AS n FROM vote GROUP BY ALL),
unseen AS (SELECT vec_id, vote, count(*) AS n FROM vote JOIN drawn USING (vec_id, r) WHERE w = 0 GROUP BY ALL),
a AS (SELECT vec_id, arg_max(vote, (n, -vote)) AS prediction FROM every GROUP BY ALL),
b AS (SELECT vec_id, arg_max(vote, (n, -vote)) AS out_of_bag FROM unseen GROUP BY ALL)
SELECT vec_id, cls, prediction, out_of_bag FROM e JOIN a USING (vec_id) LEFT JOIN b USING (vec_id)""")
def bagged_votes(spark, sf_dir):
    rows = _quadrants(spark, sf_dir)
    model = ensembles.BaggedGaussian(featuresCol="x", labelCol="cls", keyCol="vec_id", replicates=10).fit(rows)
    return model.transform(rows).select("vec_id", "cls", "prediction", "out_of_bag")


@query(f"""
WITH {_EMBEDDED},
f AS (SELECT *, CAST({_number("-1")} % 10 AS INTEGER) AS own FROM e),
long AS (SELECT vec_id, own, cls, 1.0::DOUBLE AS w, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM f),
q AS (SELECT vec_id, own AS fold, k, x FROM long),
{_scored("fold", "SELECT vec_id, fold, cls, w, x, k FROM long, range(10) t(fold) WHERE fold <> own")}
SELECT own AS fold, count(*) AS n, count_if(vote = cls) AS correct FROM f JOIN vote USING (vec_id) GROUP BY own""")
def ten_fold_scores(spark, sf_dir):
    return ensembles.fold_scores(_quadrants(spark, sf_dir), "vec_id", "x", "cls")
