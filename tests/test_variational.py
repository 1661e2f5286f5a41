"""Variational feature prior: moments, rising bound, recovered kernel."""

import numpy as np
import pytest

from tallyfold.constants import JITTER
from tallyfold.functions.mathx import np_norm_cdf, np_norm_pdf
from tallyfold.models.probit import feature_map, spd_inverse_logdet
from tallyfold.models.variational import (
    Weights,
    expected_terms,
    kernel_gradient,
    kernel_values,
    raise_bound,
    KernelSteps,
    step_sums,
    variational_prior,
    with_kernel_values,
)
from tallyfold.models.workers import ConfusionWorker, OneCoinWorker


def test_expected_terms_are_integrals():
    mean, var = np.array([-1.3, 0.0, 0.8]), np.array([0.2, 1.0, 0.6])
    got = expected_terms(mean, var)
    for i, (m, v) in enumerate(zip(mean, var)):
        f = m + np.sqrt(v) * np.linspace(-9, 9, 200_001)
        w = np_norm_pdf((f - m) / np.sqrt(v))
        w /= w.sum()
        p = np_norm_cdf(f) * (1 - 2 * JITTER) + JITTER
        s = np_norm_pdf(f) * (1 - 2 * JITTER)
        want = {"lp1": np.log(p), "lp0": np.log(1 - p), "d1": s / p, "d0": -s / (1 - p)}
        want |= {"c1": -f * s / p - (s / p) ** 2, "c0": f * s / (1 - p) - (s / (1 - p)) ** 2}
        for k, x in want.items():
            assert got[k][i] == pytest.approx((w * x).sum(), rel=0.02, abs=5e-3), k


def test_log_determinant():
    a = np.random.default_rng(0).standard_normal((6, 6))
    a = a @ a.T + np.eye(6)
    inv, logdet = spd_inverse_logdet(a)
    assert np.allclose(inv @ a, np.eye(6))
    assert logdet == pytest.approx(np.linalg.slogdet(a)[1])


def test_kernel_gradient_is_the_derivative_of_the_bound():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 4))
    target = rng.uniform(size=40)
    fmap = feature_map(None, {"linear": [0, 3], "rbf": [1, 2]}, fourier=7, lengthscales=[0.8, 1.7], variance=1.3, seed=2)
    a = rng.standard_normal((fmap.dim, fmap.dim)) * 0.3
    q = Weights.from_natural(a @ a.T + 20 * np.eye(fmap.dim), 6 * rng.standard_normal(fmap.dim))

    def bound(theta):
        phi = with_kernel_values(fmap, theta).transform(x)
        e = expected_terms(phi @ q.mean, np.einsum("ij,jk,ik->i", phi, q.cov, phi))
        return (target * e["lp1"] + (1 - target) * e["lp0"]).sum(), phi, e

    _, phi, e = bound(kernel_values(fmap))
    slope = target * e["d1"] + (1 - target) * e["d0"]
    curve = -(target * e["c1"] + (1 - target) * e["c0"])
    got = kernel_gradient(x, phi, fmap, q, slope, curve)
    log_theta = np.log(kernel_values(fmap))
    for i in range(len(got)):
        step = np.zeros(len(got))
        step[i] = 1e-4
        want = (bound(np.exp(log_theta + step))[0] - bound(np.exp(log_theta - step))[0]) / 2e-4
        assert got[i] == pytest.approx(want, rel=2e-3, abs=2e-3)


def crowd(spark, n, f, workers=5, right=0.85, seed=1):
    rng = np.random.default_rng(seed)
    truth = (rng.uniform(size=n) < np_norm_cdf(f)).astype(int)
    rows = [(i, w, int(t if rng.uniform() < right else 1 - t)) for i, t in enumerate(truth) for w in range(workers)]
    return spark.createDataFrame(rows, "task_id long, worker_id long, label int"), truth


def test_bound_never_falls_and_new_tasks_are_predicted(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (300, 2))
    ann, truth = crowd(spark, 300, 3 * x[:, 0] + 2 * np.sin(4 * x[:, 1]))
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "task_id long, features array<double>")
    fit = variational_prior(ann, feats, {"linear": [0], "rbf": [1]}, ConfusionWorker(), rounds=6, threshold=None, fourier=16)
    bounds = [v for _, m, v in fit.trace_rows if m == "evidence_bound"]
    assert len(bounds) == 7
    assert all(b >= a - 1e-6 for a, b in zip(bounds, bounds[1:]))
    labels = {r.task_id: r.label for r in fit.labels.collect()}
    assert np.mean([labels[i] == t for i, t in enumerate(truth)]) > 0.9
    new = fit.predict_new(spark.createDataFrame([(1, [1.0, 0.4]), (2, [-1.0, -0.4])], "task_id long, features array<double>"))
    p = {r.task_id: r["mean"] for r in new.collect()}
    assert p[1] > 0.9 and p[2] < 0.1


def test_known_lengthscales_are_recovered(spark):
    """A function of one dimension with a short lengthscale; the other dimension has no effect."""
    rng = np.random.default_rng(8)
    n = 1500
    x = rng.uniform(-2, 2, (n, 2))
    freq, phase = rng.standard_normal(400) / 0.5, rng.uniform(0, 2 * np.pi, 400)
    f = 2.5 * np.sqrt(2 / 400) * np.cos(np.outer(x[:, 0], freq) + phase) @ rng.standard_normal(400)
    target = np_norm_cdf(f)
    rows = spark.createDataFrame([(v.tolist(), 0.0, float(t)) for v, t in zip(x, target)], "features array<double>, shift double, target double").coalesce(2).cache()
    fmap = feature_map(None, {"rbf": [0, 1]}, fourier=96, lengthscales=[1.5, 1.5], seed=4)
    q = Weights.prior(fmap.dim)
    steps = KernelSteps(3, None)
    for _ in range(3):
        fmap, q = raise_bound(rows, fmap, q, None, True)
    for _ in range(25):
        fmap, q = raise_bound(rows, fmap, q, steps, True)
    _, short, long = kernel_values(fmap)
    assert 0.25 < short < 1.0
    assert long > 2.5 * short
    here = step_sums(rows, fmap, q)
    assert here["n"] == n


def test_empty_targets(spark):
    rows = spark.createDataFrame([], "features array<double>, shift double, target double")
    fmap = feature_map(None, {"linear": [0]})
    _, q = raise_bound(rows, fmap, Weights.prior(2), KernelSteps(1, None), True)
    assert np.allclose(q.mean, 0) and np.allclose(q.cov, np.eye(2))
    ann = spark.createDataFrame([], "task_id long, worker_id long, label int")
    feats = spark.createDataFrame([], "task_id long, features array<double>")
    fit = variational_prior(ann, feats, {"linear": [0]}, OneCoinWorker(), rounds=1)
    assert fit.labels.count() == 0
