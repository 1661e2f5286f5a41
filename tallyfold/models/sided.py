"""Other worker models for the feature prior: multiplicative skill and Gaussian-probit noise."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.constants import JITTER
from tallyfold.functions.mathx import dlit, log_sigmoid, norm_cdf, norm_pdf, sigmoid
from tallyfold.models.ascent import PairModel, ascend, start
from tallyfold.models.em import Fit, Layout, decode, index_labels, posterior, relative_change_below
from tallyfold.models.probit import (
    PriorFit,
    feature_map,
    latent,
    log_prior_table,
    mapped,
    mean_offset,
    newton_probit,
    predict,
)
from tallyfold.models.workers import own_posterior
from tallyfold.operators import skew
from tallyfold.operators.annotations import canonical
from tallyfold.operators.evaluation import to_class
from tallyfold.session import Scratch


class SkillModel(PairModel):
    """p(correct) = sigmoid(beta_i * alpha_j); beta > 0 with Gamma(1,1), alpha with N(0,1) priors.

    beta is stepped through its logarithm, so it stays positive.
    """

    worker_init = {"alpha": 1.0}
    task_init = {"log_beta": 0.0}

    @staticmethod
    def _x(p):
        return p["alpha"] * F.exp(F.least(p["log_beta"], dlit(20)))

    def row_value(self, p):
        x, g = self._x(p), own_posterior(2)
        return g * log_sigmoid(x) + (dlit(1) - g) * log_sigmoid(-x)

    def row_gradients(self, p):
        x = self._x(p)
        slope = own_posterior(2) - sigmoid(x)
        return {"alpha": slope * F.exp(F.least(p["log_beta"], dlit(20))), "log_beta": slope * x}

    def penalty(self, name, value):
        return dlit(-0.5) * value * value if name == "alpha" else -F.exp(value)

    def penalty_gradient(self, name, value):
        return -value if name == "alpha" else -F.exp(value)

    def likelihood(self, truth: int):
        x = self._x({n: F.col(n) for n in ("alpha", "log_beta")})
        return F.when(F.col("label") == truth, sigmoid(x)).otherwise(sigmoid(-x))


class NoiseModel(PairModel):
    """y_ij ~ Phi((f_i + mu_i + mu_j) / sqrt(1 + s_i^2 + s_j^2)), directly on the labels.

    The inner Gaussian integral is in closed form.  Priors: N(0,1) on offsets,
    Gamma(1,1) on variances (stepped through their logarithm), and N(m_i, v) on
    the latent f_i, with ``m_i`` in column ``f_prior`` and v = ``f_prior_var``.
    """

    def __init__(self, noise: float = 0.1):
        lv = math.log(max(noise, 1e-3))
        self.worker_init = {"worker_mean": 0.0, "worker_lv": lv}
        self.task_init = {"f_gap": 0.0, "task_mean": 0.0, "task_lv": lv}

    # f_i = f_prior + f_gap, so the prior of f_gap is N(0, 1)
    @staticmethod
    def _parts(p):
        vi, vj = F.exp(p["task_lv"]), F.exp(p["worker_lv"])
        scale = F.sqrt(dlit(1) + vi + vj)
        u = (F.col("f_prior") + p["f_gap"] + p["task_mean"] + p["worker_mean"]) / scale
        sign = F.when(F.col("label") == 1, dlit(1)).otherwise(dlit(-1))
        p_obs = norm_cdf(sign * u) * dlit(1 - 2 * JITTER) + dlit(JITTER)
        return u, scale, vi, vj, sign, p_obs

    def row_value(self, p):
        return F.ln(self._parts(p)[5])

    def row_gradients(self, p):
        u, scale, vi, vj, sign, p_obs = self._parts(p)
        du = sign * norm_pdf(u) * dlit(1 - 2 * JITTER) / p_obs
        shift = du / scale
        spread = dlit(-0.5) * du * u / (scale * scale)
        return {
            "f_gap": shift,
            "task_mean": shift,
            "worker_mean": shift,
            "task_lv": spread * vi,
            "worker_lv": spread * vj,
        }

    def penalty(self, name, value):
        return -F.exp(value) if name.endswith("_lv") else dlit(-0.5) * value * value

    def penalty_gradient(self, name, value):
        return -F.exp(value) if name.endswith("_lv") else -value


def skill_prior(
    ann: DataFrame,
    features: DataFrame,
    dims: dict[str, list[int]],
    rounds: int = 5,
    threshold: float | None = 1e-4,
    inner_steps: int = 2,
    newton_steps: int = 2,
    mean_function: str = "zero",
    fourier: int = 64,
    lengthscales: Sequence[float] | None = None,
    seed: int = 0,
    rows_per_part: int = skew.ROWS_PER_PART,
) -> PriorFit:
    """Feature prior with the multiplicative skill worker model."""
    scratch = Scratch(ann.sparkSession)
    ann = canonical(ann, "max")
    layout = Layout(index_labels(ann, [0, 1]), scratch, rows_per_part)
    model = SkillModel()
    like = [model.likelihood(t) for t in range(2)]
    trace: list[tuple[int, str, float]] = []
    try:
        fmap = feature_map(features, dims, fourier, lengthscales, seed=seed)
        phi = scratch.cut(mapped(mean_offset(features, ann, mean_function), fmap), "phi")
        weights, cov = np.zeros(fmap.dim), np.eye(fmap.dim)
        workers, tasks = start(layout, scratch, model)
        last = None
        for t in range(1, rounds + 1):
            prior = log_prior_table(latent(phi, weights, cov))
            post = scratch.cut(
                posterior(layout, workers, like, None, task_prior=prior, task_params=tasks), "posterior"
            )
            value = float(post.agg(F.sum("evidence")).first()[0]) - 0.5 * float(weights @ weights)
            trace.append((t, "evidence_bound", value))
            if last is not None and relative_change_below(value, last, threshold):
                break
            last = value
            workers, tasks, _ = ascend(
                layout, scratch, model, workers, tasks, post.select("task_id", "g0", "g1"), inner_steps
            )
            targets = phi.join(post.select("task_id", F.col("g1").alias("target")), "task_id")
            weights, cov = newton_probit(targets, fmap.dim, weights, newton_steps)
        f = scratch.cut(latent(phi, weights, cov), "latent")
        post = scratch.cut(
            posterior(layout, workers, like, None, task_prior=log_prior_table(f), task_params=tasks), "posterior"
        )
        workers, tasks = scratch.cut(workers, "workers"), scratch.cut(tasks, "tasks")
    finally:
        layout.close()
    return PriorFit(
        "prior-glad",
        decode(post, [0, 1]),
        workers.select("worker_id", F.col("alpha").alias("competence")),
        tasks.select("task_id", F.exp("log_beta").alias("easiness")),
        trace,
        feature_map=fmap, weights=weights, covariance=cov, predictions=predict(f),
    )


def _noise_tables(workers: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        workers.select("worker_id", "worker_mean", F.exp("worker_lv").alias("worker_var")),
        tasks.select("task_id", "task_mean", F.exp("task_lv").alias("task_var")),
    )


def gaussian_noise(
    ann: DataFrame, noise: float = 0.1, steps: int = 10, step_size: float | None = None,
    rows_per_part: int = skew.ROWS_PER_PART,
) -> Fit:
    """Gaussian-probit model without features: free f_i ~ N(0,1), label = f_i >= 0."""
    scratch = Scratch(ann.sparkSession)
    layout = Layout(index_labels(canonical(ann, "max"), [0, 1]), scratch, rows_per_part)
    model = NoiseModel(noise)
    try:
        workers, tasks = start(layout, scratch, model)
        data = tasks.select("task_id", F.lit(0.0).alias("f_prior"))
        workers, tasks, values = ascend(layout, scratch, model, workers, tasks, data, steps, step_size)
        workers, tasks = scratch.cut(workers, "workers"), scratch.cut(tasks, "tasks")
    finally:
        layout.close()
    by_worker, by_task = _noise_tables(workers, tasks)
    labels = tasks.select("task_id", to_class("f_gap", 0.0).alias("label"), F.col("f_gap").alias("score"))
    trace = [(i + 1, "objective", v) for i, v in enumerate(values)]
    return Fit("noise", labels, by_worker, by_task, trace)


def noise_prior(
    ann: DataFrame,
    features: DataFrame,
    dims: dict[str, list[int]],
    noise: float = 0.1,
    rounds: int = 3,
    inner_steps: int = 3,
    newton_steps: int = 2,
    mean_function: str = "zero",
    fourier: int = 64,
    lengthscales: Sequence[float] | None = None,
    seed: int = 0,
    rows_per_part: int = skew.ROWS_PER_PART,
) -> PriorFit:
    """Gaussian-probit model whose latent f_i is centred on a feature function.

    Alternates ascent on the task and worker parameters with a refit of the
    feature weights on the soft labels Phi(f_i).
    """
    scratch = Scratch(ann.sparkSession)
    ann = canonical(ann, "max")
    layout = Layout(index_labels(ann, [0, 1]), scratch, rows_per_part)
    model = NoiseModel(noise)
    trace: list[tuple[int, str, float]] = []
    try:
        fmap = feature_map(features, dims, fourier, lengthscales, seed=seed)
        phi = scratch.cut(mapped(mean_offset(features, ann, mean_function), fmap), "phi")
        weights, cov = np.zeros(fmap.dim), np.eye(fmap.dim)
        workers, tasks = start(layout, scratch, model)
        for t in range(1, rounds + 1):
            f = scratch.cut(latent(phi, weights, cov), "latent")
            data = tasks.select("task_id").join(f, "task_id", "left").select(
                "task_id", F.coalesce(F.col("f_mean"), F.lit(0.0)).alias("f_prior")
            )
            workers, tasks, values = ascend(layout, scratch, model, workers, tasks, data, inner_steps)
            trace += [(t, "objective", v) for v in values[-1:]]
            soft = tasks.join(data, "task_id").select(
                "task_id", norm_cdf(F.col("f_prior") + F.col("f_gap")).alias("target")
            )
            weights, cov = newton_probit(
                scratch.cut(phi.join(soft, "task_id"), "targets"), fmap.dim, weights, newton_steps
            )
        f = scratch.cut(latent(phi, weights, cov), "latent")
        workers, tasks = scratch.cut(workers, "workers"), scratch.cut(tasks, "tasks")
    finally:
        layout.close()
    by_worker, by_task = _noise_tables(workers, tasks)
    final = tasks.join(f, "task_id", "left").select(
        "task_id",
        (F.coalesce(F.col("f_mean"), F.lit(0.0)) + F.col("f_gap")).alias("f_mean"),
        F.coalesce(F.col("f_var"), F.lit(1.0)).alias("f_var"),
    )
    scored = predict(final)
    return PriorFit(
        "prior-noise",
        scored.select("task_id", "label", F.col("mean").alias("score")),
        by_worker,
        by_task,
        trace,
        feature_map=fmap, weights=weights, covariance=cov, predictions=scored,
    )
