"""The Bayesian mixture against a plain version, and on groups that are known."""

import math

import numpy as np
import pytest
from rasterloom.operators import mixtures


def _rows(seed=3):
    rng = np.random.default_rng(seed)
    groups = [((0, 0), 0.5, 300), ((6, 1), 0.8, 200), ((1, 7), 0.4, 100)]
    x = np.concatenate([rng.normal(m, s, size=(n, 2)) for m, s, n in groups])
    return x, np.repeat(range(3), [n for _, _, n in groups])


def _frame(spark, x):
    rows = [(i, float(a), float(b), "z") for i, (a, b) in enumerate(x)]
    return spark.createDataFrame([*rows, (-1, None, 1.0, "z"), (-2, float("nan"), 1.0, None)], "id long, a double, b double, x string").repartition(5)


def test_digamma():
    xs = np.array([0.3, 1.0, 2.5, 40.0])
    assert mixtures.digamma(xs) == pytest.approx([(math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5 for x in xs], abs=1e-6)
    assert mixtures.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)


def _plain(x, k, starts, steps):
    """Row by row and component by component, by the update equations as they stand in textbooks."""
    n, d = x.shape
    m0, s0 = x.mean(axis=0), np.cov(x.T, bias=True)
    s0 = s0 + np.eye(d) * 1e-9 * max(1.0, np.trace(s0))
    r = np.array([[-0.5 * (v - c) @ np.linalg.inv(s0) @ (v - c) * k * k for c in starts] for v in x])
    for _ in range(steps):
        r = np.exp(r - r.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
        nk = r.sum(axis=0)
        alpha, beta, nu = 1 / k + nk, 1 + nk, d + nk
        mean, w = [], []
        for j in range(k):
            bar = r[:, j] @ x / max(nk[j], 1e-300)
            scatter = sum(r[i, j] * np.outer(x[i] - bar, x[i] - bar) for i in range(n))
            mean.append((m0 + nk[j] * bar) / beta[j])
            w.append(np.linalg.inv(s0 + scatter + nk[j] / beta[j] * np.outer(bar - m0, bar - m0)))
        psi = lambda v: float(mixtures.digamma(np.array([v]))[0])
        pi = [psi(a) - psi(alpha.sum()) for a in alpha]
        lam = [sum(psi((nu[j] - i) / 2) for i in range(d)) + d * math.log(2) + math.log(np.linalg.det(w[j])) for j in range(k)]
        r = np.array([[pi[j] + lam[j] / 2 - d / 2 * math.log(2 * math.pi) - (d / beta[j] + nu[j] * (v - mean[j]) @ w[j] @ (v - mean[j])) / 2 for j in range(k)] for v in x])
    return alpha, np.array(mean), np.array(w)


def test_equals_a_plain_version(spark):
    x, _ = _rows()
    x = x[::4]
    starts = np.array([[0.0, 0.0], [5.0, 0.0], [0.0, 6.0], [3.0, 3.0]])
    model = mixtures.fit(_frame(spark, x), ["a", "b"], 4, steps=8, tolerance=-1.0, starts=starts)
    alpha, mean, scale = _plain(x, 4, starts, 8)
    assert model.weight == pytest.approx(alpha, abs=1e-6) and model.mean == pytest.approx(mean, abs=1e-6) and model.scale == pytest.approx(scale, rel=1e-6)
    assert len(model.bounds) == 7


def test_bound_never_falls_and_spare_components_vanish(spark):
    x, owner = _rows()
    rows = _frame(spark, x)
    model = mixtures.fit(rows, ["a", "b"], 7, weight=0.001)
    assert len(model.bounds) > 2 and all(b >= a - 1e-7 * abs(a) for a, b in zip(model.bounds, model.bounds[1:], strict=False))
    assert sorted(model.shares)[-3:] == pytest.approx([1 / 6, 1 / 3, 1 / 2], abs=0.02) and sorted(model.shares)[:-3] == pytest.approx([0] * 4, abs=0.005)
    got = {r.id: (r.component, r.share) for r in mixtures.assign(rows, "id", ["a", "b"], model).collect()}
    assert got[-1] == got[-2] == (None, None) and len(got) == len(x) + 2
    assert np.mean([got[i][0] == owner[i] for i in range(len(x))]) > 0.99


def test_divergence_is_zero_at_the_prior():
    spread = np.array([[2.0, 0.3], [0.3, 1.0]])
    prior = mixtures.Prior(0.5, np.array([1.0, -1.0]), 1.0, 2.0, spread)
    same = mixtures.posterior(prior, np.zeros(3), np.zeros((3, 2)), np.zeros((3, 2, 2)))
    assert same.divergence(prior) == pytest.approx(0, abs=1e-12)
    assert mixtures.posterior(prior, np.ones(3), np.ones((3, 2)), np.ones((3, 2, 2))).divergence(prior) > 0


def test_few_rows_are_refused(spark):
    with pytest.raises(ValueError):
        mixtures.fit(_frame(spark, np.zeros((1, 2))), ["a", "b"], 2)
    with pytest.raises(ValueError):
        mixtures.fit(_frame(spark, np.zeros((0, 2))).filter("id > 0"), ["a", "b"], 2)
    model = mixtures.fit(_frame(spark, np.ones((5, 2))), ["a", "b"], 2)
    assert np.isfinite(model.mean).all()
