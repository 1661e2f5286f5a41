"""Expectation propagation of the Gaussian-probit model against sampling from the prior."""

import numpy as np
import pytest

from tallyfold.functions.mathx import np_norm_cdf
from tallyfold.models.propagation import gaussian_noise_moments, noise_prior_moments

ANN = "task_id long, worker_id long, label int"
ROWS = [(0, 0, 1), (0, 1, 1), (0, 2, 0), (1, 0, 0), (1, 2, 0), (2, 1, 1), (3, 0, 1), (3, 1, 1), (3, 2, 1)]


def sampled(rows, noise, n=400_000):
    """Posterior means and variances of f and of the worker offsets by weighting draws from the prior."""
    rng = np.random.default_rng(0)
    f, mu, off = rng.standard_normal((4, n)), rng.standard_normal((4, n)), rng.standard_normal((3, n))
    log_w = np.zeros(n)
    for i, j, y in rows:
        p = np_norm_cdf((f[i] + mu[i] + off[j]) / np.sqrt(1 + 2 * noise))
        log_w += np.log(np.maximum(p if y else 1 - p, 1e-12))
    w = np.exp(log_w - log_w.max())
    w /= w.sum()
    return [((x * w).sum(1), (x * x * w).sum(1) - (x * w).sum(1) ** 2) for x in (f, off)]


@pytest.mark.parametrize("rows_per_part", [2_000_000, 2])
def test_moments_match_sampling(spark, rows_per_part):
    ann = spark.createDataFrame(ROWS, ANN)
    fit = gaussian_noise_moments(ann, noise=0.3, sweeps=12 if rows_per_part > 2 else 6, damping=0.9, tolerance=1e-4, rows_per_part=rows_per_part)
    (f, fv), (off, offv) = sampled(ROWS, 0.3)
    tasks = {r.task_id: r for r in fit.tasks.collect()}
    workers = {r.worker_id: r for r in fit.workers.collect()}
    for i in range(4):
        assert tasks[i].f_mean == pytest.approx(f[i], abs=0.03)
        assert tasks[i].f_var == pytest.approx(fv[i], abs=0.03)
    for j in range(3):
        assert workers[j].worker_mean == pytest.approx(off[j], abs=0.03)
        assert workers[j].worker_var == pytest.approx(offv[j], abs=0.03)
    changes = [v for _, _, v in fit.trace_rows]
    assert changes[-1] < changes[0] / 20


def test_given_noise_tables_weaken_a_worker(spark):
    rows = [(t, w, int(t % 2 if w < 2 else 1)) for t in range(10) for w in range(3)]
    ann = spark.createDataFrame(rows, ANN)
    noisy = spark.createDataFrame([(2, 50.0)], "worker_id long, worker_var double")
    fit = gaussian_noise_moments(ann, sweeps=5, damping=0.8, noise_tables=(noisy, spark.createDataFrame([], "task_id long, task_var double")))
    assert {r.task_id: r.label for r in fit.labels.collect()} == {t: t % 2 for t in range(10)}
    assert {r.worker_id: round(r.worker_var, 3) for r in fit.workers.collect()}[2] > 0.5


def test_features_reach_tasks_without_labels_and_empty_tables(spark):
    x = np.linspace(-1, 1, 41)
    rows = [(i, w, int(v > 0)) for i, v in enumerate(x) if i % 4 for w in range(3)]
    feats = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate(x)], "task_id long, features array<double>")
    fit = noise_prior_moments(spark.createDataFrame(rows, ANN), feats, {"linear": [0]}, sweeps=6, damping=0.8)
    labels = {r.task_id: r.label for r in fit.labels.collect()}
    assert len(labels) == 41
    assert np.mean([labels[i] == (v > 0) for i, v in enumerate(x)]) > 0.95
    none = gaussian_noise_moments(spark.createDataFrame([], ANN), sweeps=1)
    assert none.labels.count() == 0
