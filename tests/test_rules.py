"""Probabilities, chains, clusters and rules against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from rasterloom.functions import probability
from rasterloom.operators import classify, density, ensembles, patterns, tiles
from rasterloom.sources import slot_files


def _student(r, n):
    """Two-sided p-value by Simpson's rule over Student's density."""
    free = n - 2
    t = abs(r) * math.sqrt(free / (1 - r * r)) if abs(r) < 1 else math.inf
    if math.isinf(t):
        return 0.0
    norm = math.exp(math.lgamma((free + 1) / 2) - math.lgamma(free / 2)) / math.sqrt(free * math.pi)
    x = np.linspace(0, math.atan(t / math.sqrt(free)), 20_001)
    y = norm * math.sqrt(free) * np.cos(x) ** (free - 1)
    w = np.ones_like(x)
    w[1:-1:2], w[2:-1:2] = 4, 2
    return 1 - 2 * float((w * y).sum() * (x[1] - x[0]) / 3)


def test_log_gamma_and_p_values(spark):
    xs = [0.25, 0.5, 1.0, 1.5, 3.7, 20.0, 500.5]
    got = [row[0] for row in spark.createDataFrame([(x,) for x in xs], "x double").select(probability.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], abs=1e-11)
    cases = [(r, n) for r in (-1.0, -0.95, -0.3, 0.0, 0.01, 0.2, 0.7, 0.999, 1.0) for n in (3, 4, 5, 13, 40, 1001)]
    rows = spark.createDataFrame([*cases, (0.5, 2), (None, 9)], "r double, n int")
    got = [row[0] for row in rows.select(probability.correlation_p(F.col("r"), F.col("n"))).collect()]
    assert got[:-2] == pytest.approx([_student(r, n) for r, n in cases], abs=1e-9)
    assert got[-2:] == [None, None]


def test_chain_goes_over_skipped_days(spark):
    value = lambda t: math.cos(2 * math.pi * (t - 5 + t // 40) / 12)  # noqa: E731  (a day of 12 slots, drifting)
    here = [t for t in range(120) if not 40 <= t < 62]
    cube = spark.createDataFrame([(t, 0, 0, value(t), "x") for t in here] + [(t, 1, 0, None, "x") for t in here], "t int, lat_i int, lon_i int, cosz double, k string")
    for midday in (False, True):
        want, at, k = [], 0, 0
        while True:
            k += 1
            window = [t for t in here if at + 9 <= t < at + 15]
            if at + 9 > here[-1]:
                break
            if window:
                at = min(window, key=lambda t: ((-1 if midday else 1) * value(t), t))
                want.append((k, at))
            else:
                at += 12
        got = patterns.next_extremes(cube, 12, midday).orderBy("k").collect()
        assert [(r.k, r.t) for r in got] == want and {r.lat_i for r in got} == {0}
        assert any(b[0] - a[0] > 1 for a, b in zip(want, want[1:], strict=False))
    assert patterns.next_extremes(cube.filter("t < 0"), 12).count() == 0


def test_broad_snow_follows_the_rim(spark):
    """Only what the watershed calls the rim of the dark, or the plain test, is broad snow."""
    rng, shape = np.random.default_rng(3), (3, 6, 6)
    ndsi = np.where(rng.random(shape) < 0.8, 0.1, 0.5)
    rows = [(t, i, j, float(ndsi[t, i, j]), 0.5 if i else 0.1, j > 0, 0.5 if t else 2.0) for t, i, j in np.ndindex(shape)]
    cube = spark.createDataFrame(rows, "t int, lat_i int, lon_i int, ndsi double, vis double, is_land boolean, zen double")
    rim = {(r.t, r.lat_i, r.lon_i): r.rim for r in tiles.watershed_volume(cube.withColumn("u", F.col("ndsi") < 0.25), "u").collect()}
    for size in ((16, 64, 64), (2, 4, 3)):
        got = {(r.t, r.lat_i, r.lon_i): r.broad for r in classify.broad_snow(cube, size).collect()}
        assert got == {(t, i, j): bool(t and j and i and (rim[t, i, j] or ndsi[t, i, j] > 0.3)) for t, i, j in np.ndindex(shape)}
    assert any(rim.values()) and any(got.values())


def test_density_clusters(spark):
    rng = np.random.default_rng(8)
    crowd = np.concatenate([rng.normal(0, 0.02, (150, 2)), rng.normal([1, 0], 0.15, (60, 2)), [[0.08 * i, 0.6] for i in range(12)], rng.random((40, 2)) * 2, [[0.5, 0.5]] * 7])
    rows = [(int(i), float(x), float(y), "c") for i, (x, y) in zip(rng.permutation(len(crowd)), crowd, strict=True)]
    eps, least = 0.1, 5
    at = {i: (x, y) for i, x, y, _ in rows}
    near = {i: [j for j, q in at.items() if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= eps * eps] for i, p in at.items()}
    core = {i for i, n in near.items() if len(n) >= least}
    name = {}
    for i in sorted(core):
        stack = [i]
        while stack:
            j = stack.pop()
            if j not in name:
                name[j] = i
                stack += [k for k in near[j] if k in core]
    want = {i: (i in core, name.get(i, min((name[j] for j in near[i] if j in core), default=None))) for i in at}
    points = spark.createDataFrame([*rows, (-1, None, 0.0, "c"), (-2, 0.0, None, "c")], "id long, x double, y double, cell string")
    got = {r.id: (r.is_core, r.cluster) for r in density.clusters(points, "id", ["x", "y"], eps, least).collect()}
    assert got == {**want, -1: (False, None), -2: (False, None)}
    assert len(set(name.values())) > 3 and any(not c and n is not None for c, n in want.values()) and any(n is None for _, n in want.values())
    assert density.clusters(points.filter("x is null"), "id", ["x", "y"], eps, least).filter("cluster is not null").count() == 0


def test_slot_files(spark, tmp_path):
    p, spd = str(tmp_path / "slots"), 4
    rows = [(100 + t // spd, t % spd, i, j, None if (i, j) == (0, 1) else float(t * 10 + i + j / 4)) for t in range(12) if t != 5 for i in range(3) for j in range(4)]
    labels = spark.createDataFrame(rows, "dfb int, slot int, lat_i int, lon_i int, label double")
    made = slot_files.write_slots(labels, p, "CT", spd, (3, 4)).collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in made)[0] == "19800410000000-CT_LATLON.npy" and len(made) == 11
    (tmp_path / "slots" / slot_files.file_name(100, 3, "CT", spd)).write_bytes(b"broken")
    for other in ("notes.txt", "19800410000000-CSP_LATLON.npy", "19801340000000-CT_LATLON.npy", "19800410010000-CT_LATLON.npy"):
        (tmp_path / "slots" / other).write_bytes(b"x")
    want = {(d, s, i, j): v for d, s, i, j, v in rows if (d, s) != (100, 3)}
    removed = slot_files.read_slots(spark, p, 100, 102, kind="CT", holes="remove").collect()
    assert {(r.dfb, r.slot, r.lat_i, r.lon_i): r.label for r in removed} == want
    kept = slot_files.read_slots(spark, p, 100, 102, kind="CT", window="1,3,0,2").collect()
    assert {(r.t, r.lat_i, r.lon_i): r.label for r in kept} == {((d - 100) * spd + s, i, j): want.get((d, s, i + 1, j), -10.0) for d in (100, 101, 102) for s in range(spd) for i in range(2) for j in range(2)}
    # filters go on to the file names: other files are no partitions
    few = slot_files.read_slots(spark, p, 100, 102, kind="CT", holes="remove").filter("dfb >= 101 and dfb < 102 and slot in (0, 2) and label > 1")
    assert few.rdd.getNumPartitions() == 2 and {(r.dfb, r.slot) for r in few.collect()} == {(101, 0), (101, 2)}
    assert {r.slot for r in slot_files.read_slots(spark, p, 100, 102, kind="CT", slot_step=2).select("slot").distinct().collect()} == {0, 2}
    assert slot_files.read_slots(spark, p, 90, 92, kind="CT", holes="remove").count() == 0
    assert slot_files.window((40.0, 45.0), (120.0, 121.0), 115.0) == (495, 660, 165, 198)
    assert slot_files.parse_name("19800230000000-CT_LATLON.npy", spd) is None
    with pytest.raises(Exception, match="kind"):
        slot_files.read_slots(spark, p, 100, 102, kind="XX").count()


def test_bagging_saves_and_scores(spark, tmp_path):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 3, 300)
    x = rng.normal(0, 1, (300, 4)) + 4 * np.eye(4)[y]
    rows = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(300)] + [(900, None, 1), (901, [1.0, None, 1.0, 1.0], 1), (902, [4.0, 0.0, 0.0, 0.0], None)]
    data = spark.createDataFrame(rows, "id long, features array<double>, label int")
    model = ensembles.BaggedGaussian(replicates=7).fit(data)
    got = {r.id: (r.prediction, r.out_of_bag) for r in model.transform(data).collect()}
    assert got[900] == got[901] == (None, None) and got[902][0] == 0 and len(got) == 303
    judged = [(got[i][1], int(y[i])) for i in range(300) if got[i][1] is not None]
    assert len(judged) > 270 and sum(a == b for a, b in judged) / len(judged) > 0.95
    path = str(tmp_path / "model")
    model.save(path)
    again = ensembles.BaggedGaussianModel.load(path)
    assert again.uid == model.uid and again.getOrDefault("replicates") == 7
    assert {r.id: (r.prediction, r.out_of_bag) for r in again.transform(data.repartition(5)).collect()} == got
    ensembles.BaggedGaussian(replicates=7).save(str(tmp_path / "estimator"))
    assert ensembles.BaggedGaussian.load(str(tmp_path / "estimator")).getOrDefault("replicates") == 7
    scores = ensembles.fold_scores(data, "id", "features", "label").collect()
    assert sum(r.correct for r in scores) / sum(r.n for r in scores) > 0.95 and len(scores) == 10
    # a key's draws are its own: near one a row on average, none for about a third
    drawn = [r[0] for r in spark.range(4000).select(ensembles.draws(F.col("id"), 3)).collect()]
    assert 0.94 < np.mean(drawn) < 1.06 and 0.34 < np.mean(np.array(drawn) == 0) < 0.40
    assert ensembles.fold_scores(data.limit(0), "id", "features", "label").count() == 0
