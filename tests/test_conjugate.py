"""Conjugate-gradient M-step of GLAD against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.models.ascent import start
from tallyfold.models.conjugate import climb
from tallyfold.models.em import Layout
from tallyfold.models.glad import GladModel, glad
from tallyfold.session import Scratch


def rows(n_tasks=40, n_workers=6, seed=2):
    rng = np.random.default_rng(seed)
    skill = rng.uniform(0.55, 0.95, n_workers)
    truth = rng.integers(0, 2, n_tasks)
    return [(i, j, int(truth[i] if rng.uniform() < skill[j] else 1 - truth[i])) for i in range(n_tasks) for j in range(n_workers) if (i + j) % 4]


def numpy_optimum(data, g1, steps=4000):
    """Plain gradient ascent on Q with unit priors around 1."""
    t, w, y = (np.array(c) for c in zip(*data))
    g = np.where(y == 1, g1[t], 1 - g1[t])
    a, b = np.ones(w.max() + 1), np.ones(t.max() + 1)
    for _ in range(steps):
        x = a[w] * np.exp(b[t])
        slope = g - 1 / (1 + np.exp(-x))
        da = np.bincount(w, slope * np.exp(b[t])) - (a - 1)
        db = np.bincount(t, slope * x) - (b - 1)
        a, b = a + 0.01 * da, b + 0.01 * db
    return a, b


def numpy_value(data, g1, a, b):
    t, w, y = (np.array(c) for c in zip(*data))
    g, x = np.where(y == 1, g1[t], 1 - g1[t]), a[w] * np.exp(b[t])
    fit = -g * np.log1p(np.exp(-x)) - (1 - g) * np.log1p(np.exp(x))
    return fit.sum() - ((a - 1) ** 2).sum() / 2 - ((b - 1) ** 2).sum() / 2


def climbed(spark, data, g1, rows_per_part, **how):
    ann = spark.createDataFrame(data, "task_id long, worker_id long, label int")
    scratch = Scratch(spark)
    layout = Layout(ann, scratch, rows_per_part)
    try:
        model = GladModel(2)
        workers, tasks = start(layout, scratch, model)
        post = spark.createDataFrame([(i, float(1 - p), float(p)) for i, p in enumerate(g1)], "task_id long, g0 double, g1 double")
        workers, tasks, path = climb(layout, scratch, model, workers, tasks, post, **how)
    finally:
        layout.close()
    a = np.array([r.alpha for r in workers.orderBy("worker_id").collect()])
    return a, np.array([r.beta for r in tasks.orderBy("task_id").collect()]), path


def test_climb_reaches_the_optimum(spark):
    data = rows()
    g1 = np.random.default_rng(0).uniform(0.05, 0.95, 40)
    got_a, got_b, path = climbed(spark, data, g1, 2_000_000, steps=25, tolerance=0.06)
    assert path[-1].gradient_norm <= 0.06
    values = [s.objective for s in path]
    assert all(y > x for x, y in zip(values, values[1:]))
    a, b = numpy_optimum(data, g1)
    best = numpy_value(data, g1, a, b)
    assert abs(path[-1].objective - best) < 0.05
    assert path[-1].objective == pytest.approx(numpy_value(data, g1, got_a, got_b))
    assert np.allclose(got_a, a, atol=0.1)


def test_split_keys_give_the_same_steps(spark):
    data = rows()
    g1 = np.random.default_rng(0).uniform(0.05, 0.95, 40)
    one, many = (climbed(spark, data, g1, n, steps=2) for n in (2_000_000, 10))
    assert np.allclose(one[0], many[0]) and np.allclose(one[1], many[1])


def test_glad_with_conjugate_steps_settles(spark):
    ann = spark.createDataFrame([(str(t), w, y) for t, w, y in rows()], "task_id string, worker_id long, label int")
    fit = glad(ann, rounds=1, threshold=0.0)
    q = [v for _, m, v in fit.trace_rows if m == "q"]
    assert len(q) == 2 and all(np.isfinite(q))
    assert fit.labels.count() == 40
    assert fit.workers.filter(F.col("competence").isNull()).count() == 0
    with pytest.raises(ValueError, match="solver"):
        glad(ann, solver="newton")
