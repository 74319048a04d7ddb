"""Bagged Gaussian classifiers and k-fold scores, all replicates or folds in one pass over the rows.

A replicate draws each row a Poisson(1) number of times, a fold holds a row
out; both follow from a hash of the row's key alone, so a rerun, another
partitioning or a lost executor draws the same.  A fit is one aggregate of
weighted counts, means and squares by replicate and class, as large as the
model; the model (replicates x classes x features) goes to the tasks that
score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_DRAWS = 12
SMOOTHING = 1e-9


def uniform(key: Column, number: Column | int) -> Column:
    """A whole number under 2^32 that follows from key and number: the first eight hex digits of the MD5 of `<key>:<number>`."""
    number = F.lit(number) if isinstance(number, int) else number
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), number.cast("string"))), 1, 8), 16, 10).cast("long")


def poisson_steps() -> list[int]:
    """From which of the 2^32 numbers on a row is drawn 1, 2, ... times."""
    return [math.floor(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k))) for k in range(1, MOST_DRAWS + 1)]


def draws(key: Column, replicate: Column | int) -> Column:
    u = uniform(key, replicate)
    out = F.lit(0)
    for least in poisson_steps():
        out = out + F.when(u >= least, 1).otherwise(0)
    return out


def moments(rows: DataFrame, by: str, features: str, label: str, weight: str) -> DataFrame:
    """`by`, label, total, mean, square (mean of squares): weighted, by replicate (or fold) and class."""
    summary = Summarizer.metrics("mean", "normL2").summary(array_to_vector(F.col(features)), F.col(weight)).alias("s")
    out = rows.groupBy(by, F.col(label).cast("int").alias("label")).agg(summary, F.sum(weight).alias("total"))
    square = F.transform(vector_to_array("s.normL2"), lambda x: x * x / F.col("total"))
    return out.select(by, "label", "total", vector_to_array("s.mean").alias("mean"), square.alias("square"))


class Gaussians:
    """Independent normal features by class; ties go to the smallest class."""

    def __init__(self, labels: list[int], total: np.ndarray, mean: np.ndarray, square: np.ndarray):
        order = np.argsort(labels)
        self.labels, self.mean = np.array(labels)[order], mean[order]
        spread = np.maximum(square[order] - self.mean**2, 0)
        self.spread = spread + SMOOTHING * max(1.0, float(spread.max(initial=0)))
        self.log_prior = np.log(total[order] / total.sum())

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.stack([p - 0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(axis=1) for p, m, v in zip(self.log_prior, self.mean, self.spread, strict=True)], axis=1)
        return self.labels[score.argmax(axis=1)]


def _models(stats: DataFrame, by: str) -> dict[int, Gaussians]:
    rows: dict[int, list] = {}
    for r in stats.collect():  # replicates x classes rows
        rows.setdefault(r[by], []).append(r)
    return {k: Gaussians([r.label for r in rs], *(np.array([r[c] for r in rs], float) for c in ("total", "mean", "square"))) for k, rs in sorted(rows.items())}


def _predicted(rows: DataFrame, features: str, models: dict[int, Gaussians]) -> DataFrame:
    """Adds `votes`: the class that each model gives, in their order."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in rows.dtypes), "votes array<int>"])
    at = rows.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(at).to_pylist(), float).reshape(batch.num_rows, -1)
            votes = np.stack([m.predict(x) for m in models.values()], axis=1) if batch.num_rows else np.zeros((0, len(models)), int)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(votes.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "votes"])

    return rows.mapInArrow(run, schema)


def majority(votes: Column) -> Column:
    """The most frequent vote, the smallest among equals; null without votes."""
    ranked = F.transform(F.array_distinct(votes), lambda v: F.struct((-F.size(F.filter(votes, lambda w: w == v))).alias("less"), v.alias("v")))
    return F.array_min(ranked)["v"]


def _whole(features: str) -> Column:
    """Are all features there?"""
    x = F.col(features)
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v))


class _Shared(HasFeaturesCol, HasLabelCol):
    keyCol = Param(Params._dummy(), "keyCol", "column of the rows' unique key", TypeConverters.toString)
    replicates = Param(Params._dummy(), "replicates", "number of replicates", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", keyCol="id", replicates=10)

class BaggedGaussian(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Fits all replicates in one pass. Rows without features or label are left out."""

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", keyCol="id", replicates=10):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BaggedGaussianModel:
        key, label, features = self.getOrDefault("keyCol"), self.getLabelCol(), self.getFeaturesCol()
        rows = dataset.filter(_whole(features) & F.col(label).isNotNull()).select(key, F.col(features).cast("array<double>").alias(features), label)
        each = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(self.getOrDefault("replicates") - 1))))
        each = each.withColumn("draws", draws(F.col(key), F.col("replicate")).cast("double")).filter("draws > 0")
        return self._copyValues(BaggedGaussianModel(moments(each, "replicate", features, label, "draws")))


class _ModelWriter(MLWriter):
    def __init__(self, model: BaggedGaussianModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.stats.write.parquet(f"{path}/stats")


class _ModelReader(MLReader):
    def load(self, path: str) -> BaggedGaussianModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = BaggedGaussianModel(self.sparkSession.read.parquet(f"{path}/stats"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


class BaggedGaussianModel(Model, _Shared, MLReadable, MLWritable):
    """Adds `prediction` (majority of all replicates) and `out_of_bag` (of those that did not draw the row; null if all did).

    Rows without features get nulls.
    """

    def __init__(self, stats: DataFrame | None = None):
        super().__init__()
        self.stats = stats

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        key, features = F.col(self.getOrDefault("keyCol")), self.getFeaturesCol()
        models = _models(self.stats, "replicate")
        rows = dataset.withColumn(features, F.col(features).cast("array<double>"))
        out = _predicted(rows.filter(_whole(features)), features, models)
        drawn = F.array(*(draws(key, r) for r in models))
        unseen = F.transform(F.filter(F.arrays_zip(F.col("votes"), drawn.alias("drawn")), lambda v: v["drawn"] == 0), lambda v: v["votes"])
        out = out.withColumn("prediction", majority(F.col("votes"))).withColumn("out_of_bag", majority(unseen)).drop("votes")
        return out.unionByName(rows.filter(~_whole(features)), allowMissingColumns=True)


def fold_scores(rows: DataFrame, key: str, features: str, label: str, folds: int = 10) -> DataFrame:
    """fold, n, correct: rows of each fold, and how many the model of all other folds gives their label.

    One aggregate by fold and class; a fold's model is what all folds have less its own.  Rows without features or label are left out.
    """
    rows = rows.filter(_whole(features) & F.col(label).isNotNull())
    rows = rows.select(F.pmod(uniform(F.col(key), -1), F.lit(folds)).cast("int").alias("fold"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("label"), F.lit(1.0).alias("w"))
    stats = moments(rows, "fold", "x", "label", "w").collect()  # folds x classes rows
    models = {}
    for fold in range(folds):
        labels, parts = sorted({r.label for r in stats if r.fold != fold}), []
        for c in labels:
            use = [r for r in stats if r.fold != fold and r.label == c]
            total = np.array([r.total for r in use])
            parts.append((total.sum(), *((total[:, None] * np.array([r[m] for r in use])).sum(axis=0) / total.sum() for m in ("mean", "square"))))
        if parts:
            models[fold] = Gaussians(labels, *(np.array(p, float) for p in zip(*parts, strict=True)))
    at = {f: i for i, f in enumerate(models)}
    place = F.element_at(F.create_map(*(F.lit(v) for f, i in at.items() for v in (f, i + 1))), F.col("fold")) if at else F.lit(None).cast("int")
    judged = _predicted(rows, "x", models).withColumn("vote", F.try_element_at("votes", place))
    return judged.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("vote") == F.col("label")).alias("correct"))
