"""A variational Bayesian mixture of Gaussians: coordinate ascent whose every step is one aggregate.

The weights have a Dirichlet prior, each component's mean and precision a
Gaussian and a Wishart one, full matrices.  A step takes each row's share in
every component (tasks add up the shares' zeroth, first and second moments of
their batches, Spark adds up the tasks'), and from these few sums follow all
posteriors.  The lower bound of the evidence comes with the same sums; it never
falls but by rounding, and the ascent ends when it stays.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by the asymptotic series ten steps further on."""
    z = np.asarray(x, float) + 10
    shift = sum(1 / (z - 1 - i) for i in range(10))
    return np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - shift


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _log_wishart(log_det: np.ndarray, free: np.ndarray, d: int) -> np.ndarray:
    """Log of the Wishart density's constant, of the log determinant of its scale."""
    i = np.arange(1, d + 1)
    return -free / 2 * log_det - free * d / 2 * math.log(2) - d * (d - 1) / 4 * math.log(math.pi) - _log_gamma((np.asarray(free)[..., None] + 1 - i) / 2).sum(axis=-1)


@dataclass(frozen=True)
class Prior:
    """Hyperparameters: weight concentration, mean and its strength, degrees of freedom, and the inverse of the precision's scale."""

    weight: float
    mean: np.ndarray
    strength: float
    free: float
    spread: np.ndarray


@dataclass(frozen=True)
class Mixture:
    """The posterior: for each of k components its weight (Dirichlet), mean, strength, degrees of freedom and precision scale."""

    weight: np.ndarray
    mean: np.ndarray
    strength: np.ndarray
    free: np.ndarray
    scale: np.ndarray
    bounds: tuple[float, ...] = ()

    @property
    def shares(self) -> np.ndarray:
        """Expected weights."""
        return self.weight / self.weight.sum()

    def _log_precision(self) -> np.ndarray:
        """Expected log determinants of the precisions."""
        d = self.mean.shape[1]
        i = np.arange(1, d + 1)
        return digamma((self.free[:, None] + 1 - i) / 2).sum(axis=1) + d * math.log(2) + np.linalg.slogdet(self.scale)[1]

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """Unnormalised log responsibilities of rows x, one column a component."""
        d = x.shape[1]
        fixed = digamma(self.weight) - digamma(self.weight.sum()) + 0.5 * (self._log_precision() - d * math.log(2 * math.pi) - d / self.strength)
        away = x[:, None, :] - self.mean
        return fixed - 0.5 * self.free * np.einsum("nki,kij,nkj->nk", away, self.scale, away)

    def divergence(self, prior: Prior) -> float:
        """From the prior (Kullback and Leibler), of all parameters."""
        k, d = self.mean.shape
        total, expected = self.weight.sum(), digamma(self.weight) - digamma(self.weight.sum())
        weights = math.lgamma(total) - _log_gamma(self.weight).sum() - math.lgamma(k * prior.weight) + k * math.lgamma(prior.weight) + ((self.weight - prior.weight) * expected).sum()
        away = self.mean - prior.mean
        means = 0.5 * (d * np.log(self.strength / prior.strength) - d + d * prior.strength / self.strength + prior.strength * self.free * np.einsum("ki,kij,kj->k", away, self.scale, away))
        held = _log_wishart(np.linalg.slogdet(self.scale)[1], self.free, d) - _log_wishart(-np.linalg.slogdet(prior.spread)[1], np.asarray(prior.free), d)
        precisions = held + (self.free - prior.free) / 2 * self._log_precision() - self.free * d / 2 + self.free / 2 * np.einsum("ij,kji->k", prior.spread, self.scale)
        return float(weights + (means + precisions).sum())


def posterior(prior: Prior, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> Mixture:
    """From the sums of shares, of shares times x, and of shares times x xT, by component."""
    strength = prior.strength + n
    mean = (prior.strength * prior.mean + first) / strength[:, None]
    outer = lambda a: np.einsum("...i,...j->...ij", a, a)
    spread = prior.spread + second + prior.strength * outer(prior.mean) - strength[:, None, None] * outer(mean)
    return Mixture(prior.weight + n, mean, strength, prior.free + n, np.linalg.inv((spread + spread.transpose(0, 2, 1)) / 2))


def moments(x: np.ndarray, log_shares: np.ndarray) -> np.ndarray:
    """One vector: the rows' log evidence, then by component the shares' zeroth, first and second moments."""
    top = log_shares.max(axis=1, keepdims=True)
    share = np.exp(log_shares - top)
    whole = share.sum(axis=1, keepdims=True)
    share /= whole
    return np.concatenate([[(np.log(whole) + top).sum()], share.sum(axis=0), (share.T @ x).ravel(), np.einsum("nk,ni,nj->kij", share, x, x).ravel()])


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(i), dtype=float) for i in range(d)]) if batch.num_rows else np.zeros((0, d))


def _summed(points: DataFrame, d: int, log_shares) -> np.ndarray:
    """The rows' moments: a vector a batch, added up by place."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, d)
                found = moments(x, log_shares(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], names=["place", "v"])

    sums = points.mapInArrow(run, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).orderBy("place").collect()  # one number a moment
    return np.array([row.v for row in sums])


def fit(points: DataFrame, xs: list[str], k: int, weight: float | None = None, steps: int = 200, tolerance: float = 1e-6, starts: np.ndarray | None = None) -> Mixture:
    """The posterior after at most `steps` steps, or when the bound a row grows by less than `tolerance`.

    Priors follow the data: mean and covariance of all rows, d degrees of
    freedom, strength 1; weight concentration 1 / k unless given (small ones
    let spare components die).  Components begin at `starts`, else along the
    first principal axis, evenly from -2 to 2 deviations.  Rows with a missing
    value are left out; fewer than two others are an error.
    """
    d = len(xs)
    there = " and ".join(f"`{x}` is not null and not isnan(`{x}`)" for x in xs)
    points = cut(points.select(*(F.col(x).cast("double").alias(x) for x in xs)).filter(there))
    one = _summed(points, d, lambda x: np.zeros((len(x), 1)))
    if not len(one) or one[1] < 2:
        raise ValueError("a mixture needs two rows")
    n = one[1]
    mean = one[2 : 2 + d] / n
    spread = one[2 + d :].reshape(d, d) / n - np.outer(mean, mean)
    spread = (spread + spread.T) / 2 + np.eye(d) * 1e-9 * max(1.0, float(np.trace(spread)))
    prior = Prior(1 / k if weight is None else weight, mean, 1.0, float(d), spread)
    size, axes = np.linalg.eigh(spread)
    axis = axes[:, -1] * (1 if axes[np.abs(axes[:, -1]).argmax(), -1] > 0 else -1)
    if starts is None:
        starts = mean + np.linspace(-2, 2, k)[:, None] * math.sqrt(size[-1]) * axis
    around = np.linalg.inv(spread) * k * k
    model = None
    log_shares = lambda x: -0.5 * np.einsum("nki,ij,nkj->nk", x[:, None] - starts, around, x[:, None] - starts)
    bounds: list[float] = []
    for _ in range(steps):
        found = _summed(points, d, log_shares if model is None else model.log_shares)
        if model is not None:
            bounds.append(found[0] - model.divergence(prior))
            if len(bounds) > 1 and bounds[-1] - bounds[-2] < tolerance * n:
                break
        found = found[1:]
        model = posterior(prior, found[:k], found[k : k + k * d].reshape(k, d), found[k + k * d :].reshape(k, d, d))
    return Mixture(model.weight, model.mean, model.strength, model.free, model.scale, tuple(bounds))


def assign(rows: DataFrame, key: str, xs: list[str], model: Mixture) -> DataFrame:
    """`key`, component (numbered by falling weight, from 0) and its share; null for rows with a missing value."""
    d, order = len(xs), np.argsort(-model.weight, kind="stable")

    def run(batches):
        for batch in batches:
            x = _matrix(batch.select(list(range(1, d + 1))), d)
            ok = np.isfinite(x).all(axis=1)
            logs = model.log_shares(np.where(ok[:, None], x, 0.0))[:, order]
            share = np.exp(logs - logs.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(share.argmax(axis=1).astype(np.int32), mask=~ok), pa.array(share.max(axis=1), mask=~ok)], names=[key, "component", "share"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs))).mapInArrow(run, f"`{key}` {kind}, component int, share double")
