"""Models on Spark ML: mixtures, clusters, projections, classifiers, neighbours, evaluation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = 32  # blocks of query vectors that are out at once


def features(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def cluster(df: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """vec_id, cluster."""
    data = features(df)
    return KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select("vec_id", F.col("prediction").alias("cluster"))


def project(df: DataFrame, k: int = 3) -> DataFrame:
    """vec_id and the first k principal components."""
    data = features(df)
    return PCA(k=k, inputCol="features", outputCol="pc").fit(data).transform(data).select("vec_id", vector_to_array("pc").alias("pc"))


def covertness(df: DataFrame, x: str, k: int = 3, seed: int = 7) -> DataFrame:
    """The rows with `grade`: the rank of their mixture component by mean (0 lowest); missing values have none."""
    ok = df.filter(F.col(x).isNotNull()).withColumn("features", array_to_vector(F.array(F.col(x).cast("double"))))
    model = GaussianMixture(k=k, seed=seed, maxIter=50).fit(ok)
    means = sorted(range(k), key=lambda i: float(model.gaussians[i].mean[0]))
    rank = F.create_map(*[F.lit(v) for i, c in enumerate(means) for v in (c, i)])
    return model.transform(ok).withColumn("grade", rank[F.col("prediction")]).drop("features", "probability", "prediction")


def classify(df: DataFrame, kind: str, seed: int = 7) -> DataFrame:
    """vec_id, label, predicted: fitted on rows whose id is not divisible by 5, applied to all."""
    data = features(df.select("vec_id", "embedding", F.col("label").cast("double").alias("label")))
    n = int(data.agg(F.max("label")).first()[0] or 0) + 1
    width = len(df.select("embedding").first()[0])
    model = {
        "forest": RandomForestClassifier(numTrees=30, seed=seed),
        "tree": DecisionTreeClassifier(impurity="entropy", seed=seed),
        "bayes": NaiveBayes(modelType="gaussian"),
        "perceptron": MultilayerPerceptronClassifier(layers=[width, 32, 32, n], seed=seed, maxIter=60),
    }[kind]
    return model.fit(data.filter("vec_id % 5 <> 0")).transform(data).select("vec_id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"))


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def centroid_vote(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """vec_id, label, predicted: the label whose mean vector is nearest (ties: the smaller label).

    Up to `limit` means are one array, joined as a single row; more are joined by dimension.
    """
    x = F.col("embedding").cast("array<double>")
    long = df.select("label", F.posexplode(x).alias("dim", "x"))
    means = long.groupBy("label", "dim").agg(F.avg("x").alias("m"))
    distance = lambda a, b: F.round(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, d: s + d), 6)
    vectors = means.groupBy(F.col("label").alias("candidate")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda p: p.getField("m")).alias("m"))
    if df.agg(F.approx_count_distinct("label").alias("n")).first().n <= limit:
        all_means = F.broadcast(vectors.agg(F.collect_list(F.struct("candidate", "m")).alias("means")))  # a single row of checked size
        best = F.array_min(F.transform("means", lambda c: F.struct(distance(F.col("_x"), c.getField("m")).alias("d"), c.getField("candidate").alias("candidate"))))
        return df.withColumn("_x", x).join(all_means).select("vec_id", "label", best.getField("candidate").alias("predicted"))
    each = df.select("vec_id", "label", F.posexplode(x).alias("dim", "x"))
    dist = each.join(means.withColumnRenamed("label", "candidate"), "dim").groupBy("vec_id", "label", "candidate").agg(F.round(F.sum(F.pow(F.col("x") - F.col("m"), 2)), 6).alias("d"))
    return dist.groupBy("vec_id", "label").agg(F.min(F.struct("d", "candidate")).alias("best")).select("vec_id", "label", F.col("best.candidate").alias("predicted"))


def knn_vote(df: DataFrame, queries: DataFrame, k: int = 7, block: int = 2048) -> DataFrame:
    """vec_id, label, predicted of the queries: the most frequent label of the k nearest other rows (ties: nearer rows first by
    distance and id, then the smaller label).

    Exact: query vectors go out `GROUP` blocks at a time; each task keeps the
    k best of its rows for every query, and these few are merged.  A product
    of matrices bounds the distances of `block` queries to 1,024 rows; those
    that may be among the k best are computed.  A task holds one group and one
    such tile, however many queries and rows there are.
    """
    spark = df.sparkSession
    rows = df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    asked = queries.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).sortWithinPartitions("vec_id")
    found = None
    for group in _groups(_blocks(asked, block)):
        part = rows.mapInArrow(_nearest(spark.sparkContext.broadcast(group), k), "query long, d double, vec_id long, label int")
        found = part if found is None else found.union(part)
    if found is None:
        return queries.select("vec_id", F.col("label").cast("int").alias("label")).withColumn("predicted", F.col("label")).limit(0)
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id", "label"))), 1, k).alias("near"))
    votes = best.select(F.col("query").alias("vec_id"), F.explode("near.label").alias("predicted")).groupBy("vec_id", "predicted").agg(F.count("*").alias("n"))
    top = votes.groupBy("vec_id").agg(F.max(F.struct("n", (-F.col("predicted")).alias("p"))).alias("t"))
    return queries.select("vec_id", F.col("label").cast("int").alias("label")).join(top, "vec_id").select("vec_id", "label", (-F.col("t.p")).cast("int").alias("predicted"))


def _blocks(asked: DataFrame, block: int):
    """Query vectors block by block."""
    ids, vectors = [], []
    for row in asked.toLocalIterator():
        ids.append(row.vec_id)
        vectors.append(row.x)
        if len(ids) == block:
            yield np.array(ids), np.array(vectors)
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.array(vectors)


def _groups(blocks):
    """Lists of GROUP blocks; the driver holds one."""
    group = []
    for b in blocks:
        group.append(b)
        if len(group) == GROUP:
            yield group
            group = []
    if group:
        yield group


def _nearest(shared, k: int):
    def run(batches):
        blocks = [_Nearest(ids, q, k) for ids, q in shared.value]
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            own, label = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(1)).astype(np.int64)
            for lo in range(0, len(x), 1024):
                cut = slice(lo, lo + 1024)
                for b in blocks:
                    b.add(own[cut], label[cut], x[cut])
        for b in blocks:
            at, d, vec, label = b.held
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[at]), pa.array(d), pa.array(vec), pa.array(label.astype(np.int32))], names=["query", "d", "vec_id", "label"])

    return run


class _Nearest:
    """The k nearest rows so far of a block of queries."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.square = (q * q).sum(axis=1)
        self.limit = np.full(len(ids), np.inf)  # the k-th distance
        self.held = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)  # place of the query, distance, id, label

    def add(self, own: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        square = (x * x).sum(axis=1)
        near = self.q @ (-2 * x.T)
        near += self.square[:, None]
        near += square
        near[self.ids[:, None] == own] = np.inf
        limit = np.minimum(self.limit, np.partition(near, self.k - 1, axis=1)[:, self.k - 1]) if len(x) >= self.k else self.limit
        limit = limit + 2e-6 + 1e-12 * (self.square + square.max())  # distances are rounded to six decimals, and products have errors of their own
        at, row = np.nonzero(~(near > limit[:, None]))
        other = self.ids[at] != own[row]
        at, row = at[other], row[other]
        d = np.zeros(len(at))
        for j in range(x.shape[1]):
            d += (self.q[at, j] - x[row, j]) ** 2
        d = np.round(d, 6)
        some = np.isfinite(d) & (d <= self.limit[at])
        if not some.any():
            return
        at, row = at[some], row[some]
        every = [np.concatenate(c) for c in zip(self.held, (at, d[some], own[row], label[row]), strict=True)]
        order = np.lexsort((every[2], every[1], every[0]))
        place = every[0][order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        self.held = tuple(c[order[rank < self.k]] for c in every)
        last = order[rank == self.k - 1]
        self.limit[every[0][last]] = every[1][last]


def likelihoods(df: DataFrame, evidence: list[str], cls: str) -> tuple[DataFrame, DataFrame]:
    """(class, prior) and (evidence name, value, class, p), with one pseudo-row for each value seen and class."""
    classes = df.groupBy(cls).agg(F.count("*").alias("n"))
    total = F.broadcast(df.agg(F.count("*").alias("all")))  # a single row
    long = df.select(cls, F.explode(F.create_map(*[x for e in evidence for x in (F.lit(e), F.col(e).cast("long"))])).alias("name", "value"))
    counts = long.groupBy("name", "value", cls).agg(F.count("*").alias("m"))
    values = counts.groupBy("name").agg(F.count_distinct("value").alias("values"))
    p = (F.col("m") + 1) / (F.col("n") + F.col("values"))
    return classes.join(total).select(cls, (F.col("n") / F.col("all")).alias("prior")), counts.join(classes, cls).join(values, "name").select("name", "value", cls, p.alias("p"))


def bayes_posterior(df: DataFrame, key: str, evidence: list[str], cls: str, priors: DataFrame, tables: DataFrame) -> DataFrame:
    """key, class, posterior: prior times the likelihoods of the evidence, over their sum (values that a class never had are left out of its product)."""
    long = df.select(key, F.explode(F.create_map(*[x for e in evidence for x in (F.lit(e), F.col(e).cast("long"))])).alias("name", "value"))
    product = long.join(tables, ["name", "value"]).groupBy(key, cls).agg(F.exp(F.sum(F.log("p"))).alias("p"))
    weight = product.join(priors, cls).withColumn("w", F.col("p") * F.col("prior"))
    total = Window.partitionBy(key)
    return weight.select(key, cls, (F.col("w") / F.sum("w").over(total)).alias("posterior"))


def _mixture(df: DataFrame, x: str, k: int, seed: int):
    """(model, rows with a value and their component, components by mean: index, mean, deviation)."""
    ok = df.filter(F.col(x).isNotNull()).withColumn("features", array_to_vector(F.array(F.col(x).cast("double"))))
    model = GaussianMixture(k=k, seed=seed, maxIter=50).fit(ok)
    parts = sorted((float(g.mean[0]), float(g.cov.toArray()[0][0]) ** 0.5, i) for i, g in enumerate(model.gaussians))
    return model, ok, parts


def _recoded(model, ok: DataFrame, parts: list, codes: list[int]) -> DataFrame:
    code = F.create_map(*[F.lit(v) for (*_, i), c in zip(parts, codes, strict=True) for v in (i, c)])
    return model.transform(ok).withColumn("grade", code[F.col("prediction")]).drop("features", "probability", "prediction")


def cloud_covertness(df: DataFrame, x: str = "cli", seed: int = 7) -> DataFrame:
    """The rows with grade: 2 undefined, 0 cloudless, 1 cloudy, by the means of 3 components in order.

    If any two neighbouring means lie closer than the largest deviation, 4 components are fitted and the upper two are cloudy.
    """
    model, ok, parts = _mixture(df, x, 3, seed)
    if min(b[0] - a[0] for a, b in zip(parts, parts[1:], strict=False)) < max(p[1] for p in parts):
        model, ok, parts = _mixture(df, x, 4, seed)
        return _recoded(model, ok, parts, [2, 0, 1, 1])
    return _recoded(model, ok, parts, [2, 0, 1])


def cloud_variability(df: DataFrame, x: str, seed: int = 7) -> DataFrame:
    """grade 1 for the two highest of 4 components, 2 for the lowest (undefined), else 0."""
    model, ok, parts = _mixture(df, x, 4, seed)
    return _recoded(model, ok, parts, [2, 0, 1, 1])


def brightness(df: DataFrame, x: str = "vis", limit: float = 0.35, seed: int = 7) -> DataFrame:
    """grade 1 for the brightest of 3 components if it is bright (mean + half a deviation over `limit`) and apart from the
    next (by 1.2 times the largest deviation), else for values over `limit`."""
    model, ok, parts = _mixture(df, x, 3, seed)
    (below, *_), (mean, deviation, _) = parts[-2], parts[-1]
    if mean + deviation / 2 > limit and mean - below > 1.2 * max(p[1] for p in parts):
        return _recoded(model, ok, parts, [0, 0, 1])
    return ok.withColumn("grade", (F.col(x) > limit).cast("int")).drop("features")


def brightness_variability(df: DataFrame, x: str, seed: int = 7) -> DataFrame:
    """grade 1 (variable) for the upper two of 3 components, 0 (constant) for the lowest."""
    model, ok, parts = _mixture(df, x, 3, seed)
    return _recoded(model, ok, parts, [0, 1, 1])


def log_likelihood(df: DataFrame, x: str, k: int, seed: int = 7) -> float:
    """Mean log-likelihood of a mixture of k components on the rows that have x."""
    model, ok, _ = _mixture(df, x, k, seed)
    return model.summary.logLikelihood / ok.count()


def components_apart(parts: list[tuple[float, float]]) -> bool:
    """Do all means lie further apart than either deviation?"""
    return all(abs(a - b) > max(s, u) for i, (a, s) in enumerate(parts) for b, u in parts[:i])


def index_histogram(df: DataFrame, x: str, bins_per_unit: int) -> DataFrame:
    """bin, n of the values over -9."""
    return df.filter(F.col(x) > -9).groupBy(F.floor(F.col(x) * bins_per_unit).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def most_likely(df: DataFrame, scores: str) -> DataFrame:
    """Adds predicted (index of the largest score, first among equals) and confidence."""
    top = F.array_max(scores)
    return df.withColumn("predicted", (F.array_position(scores, top) - 1).cast("int")).withColumn("confidence", top)
