"""Feature prior with a variational posterior of the weights and learned kernel parameters.

    z_i ~ Bernoulli(Phi(f_i)),  f_i = m(x_i) + phi(x_i) . w,  w ~ N(0, I),  q(w) = N(mu, S),  q(z) free

One bound is raised by all steps:

    sum_i sum_z q(z_i) (log p(labels_i | z_i) + E_q log p(z_i | f_i) - log q(z_i)) - KL(q(w) || p(w)) + log p(theta)

* q(z): the E-step with the expected log prior, by 20-point Gauss-Hermite quadrature of q(f_i).
* worker parameters: the worker model's own M-step.
* q(w): a natural-gradient step.  With g_i = E_q g'(f_i) and h_i = -E_q g''(f_i) of the expected log prior, the new
  precision is I + sum h_i phi phi' and the new mean solves it for sum phi (g_i + h_i phi . mu).
* theta (variances, one lengthscale per RBF dimension, Gamma(1, 1) priors): gradient of the same bound through the
  features, in the logarithm of theta.  The random draws stay; frequencies are rescaled.  A step of theta is judged
  together with the natural-gradient step that follows it, since the weights fit the old features.

Every pass over the tasks is a narrow job: a partition reduces to D(D + 3) / 2 sums and a few scalars, Spark adds
them, and only the total (D <= 512) reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.constants import JITTER
from tallyfold.functions.mathx import np_norm_cdf, np_norm_pdf
from tallyfold.functions.vectorx import gauss_hermite
from tallyfold.models.em import WorkerModel, Layout, Monitor, decode, index_labels, maximise, posterior, relative_change_below, step_columns
from tallyfold.models.probit import FeatureMap, PriorFit, feature_map, fit_mean, predict, spd_inverse_logdet
from tallyfold.operators import skew
from tallyfold.operators.annotations import canonical
from tallyfold.session import Scratch, watched

POINTS = 20
MAX_LOG_STEP = 0.5


@dataclass
class Weights:
    """q(w) = N(mean, cov)."""

    mean: np.ndarray
    cov: np.ndarray
    logdet: float  # of cov

    @classmethod
    def prior(cls, dim: int) -> Weights:
        return cls(np.zeros(dim), np.eye(dim), 0.0)

    @classmethod
    def from_natural(cls, precision: np.ndarray, shift: np.ndarray) -> Weights:
        cov, logdet = spd_inverse_logdet(precision)
        return cls((cov * shift).sum(axis=1), cov, -logdet)

    def divergence(self) -> float:
        """KL(q || N(0, I))."""
        return 0.5 * float(np.trace(self.cov) + self.mean @ self.mean - len(self.mean) - self.logdet)


def kernel_values(fmap: FeatureMap) -> np.ndarray:
    """Learned parameters in a fixed order: linear variance, RBF variance, lengthscales (those in use)."""
    out = [fmap.linear_variance] if len(fmap.linear_dims) else []
    if fmap.frequencies is not None:
        out += [fmap.rbf_variance, *fmap.lengthscales]
    return np.array(out, dtype=float)


def with_kernel_values(fmap: FeatureMap, values: np.ndarray) -> FeatureMap:
    values = [float(v) for v in values]
    linear = values.pop(0) if len(fmap.linear_dims) else fmap.linear_variance
    rbf, scales = (values[0], values[1:]) if fmap.frequencies is not None else (fmap.rbf_variance, fmap.lengthscales)
    return fmap.rescaled(linear, rbf, scales)


def kernel_log_prior(fmap: FeatureMap) -> float:
    """Gamma(1, 1) on every parameter."""
    return -float(kernel_values(fmap).sum())


def _moments(phi: np.ndarray, shift: np.ndarray, q: Weights) -> tuple[np.ndarray, np.ndarray]:
    return phi @ q.mean + shift, np.maximum(np.einsum("ij,jk,ik->i", phi, q.cov, phi, optimize=True), 0.0)


def expected_terms(mean: np.ndarray, var: np.ndarray) -> dict[str, np.ndarray]:
    """Quadrature of log p(z | f) and its two derivatives for both labels."""
    nodes, w = (np.array(v) for v in gauss_hermite(POINTS))
    f = mean[:, None] + np.sqrt(var)[:, None] * nodes
    p = np_norm_cdf(f) * (1 - 2 * JITTER) + JITTER
    s = np_norm_pdf(f) * (1 - 2 * JITTER)
    up, down = s / p, s / (1 - p)
    return {
        "lp1": np.log(p) @ w, "lp0": np.log(1 - p) @ w, "d1": up @ w, "d0": -(down @ w),
        "c1": (-f * up - up * up) @ w, "c0": (f * down - down * down) @ w,
    }


def _features(pdf: pd.DataFrame) -> np.ndarray:
    return np.vstack(pdf["features"].to_numpy()).astype(float)


def latent_terms(rows: DataFrame, fmap: FeatureMap, q: Weights) -> DataFrame:
    """``(task_id, f_mean, f_var, lp0, lp1)`` of ``rows(task_id, features, shift)``."""
    kind = rows.schema["task_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                mean, var = _moments(fmap.transform(_features(pdf)), pdf["shift"].to_numpy(float), q)
                e = expected_terms(mean, var)
                yield pd.DataFrame({"task_id": pdf["task_id"], "f_mean": mean, "f_var": var, "lp0": e["lp0"], "lp1": e["lp1"]})

    return rows.select("task_id", "features", "shift").mapInPandas(
        run, f"task_id {kind}, f_mean double, f_var double, lp0 double, lp1 double"
    )


def _summed(rows: DataFrame, size: int, per_batch: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of a vector of ``size`` numbers: partitions first, then Spark by position."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(size), 0
        for pdf in batches:
            if len(pdf):
                seen += len(pdf)
                total += per_batch(_features(pdf), pdf["shift"].to_numpy(float), pdf["target"].to_numpy(float))
        if seen:
            yield pd.DataFrame({"k": np.arange(size), "v": total})

    got = (
        rows.select("features", "shift", "target")
        .mapInPandas(run, "k long, v double")
        .groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    )
    out = np.zeros(size)
    out[got["k"].to_numpy()] = got["v"].to_numpy()
    return out


def _derivatives(e: dict[str, np.ndarray], target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """E g' and -E g'' (at least 0) for soft labels."""
    slope = target * e["d1"] + (1 - target) * e["d0"]
    return slope, np.maximum(-(target * e["c1"] + (1 - target) * e["c0"]), 0.0)


def kernel_gradient(x: np.ndarray, phi: np.ndarray, fmap: FeatureMap, q: Weights, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Gradient of the data part of the bound in the logarithms of :func:`kernel_values`, summed over rows."""
    # d bound / d phi, with d mean = mu . d phi and d var = 2 (S phi) . d phi
    a = slope[:, None] * q.mean - curve[:, None] * (phi @ q.cov)
    out, at = [], 1
    if len(fmap.linear_dims):
        block = slice(at, at + len(fmap.linear_dims))
        out.append(0.5 * (a[:, block] * phi[:, block]).sum())
        at = block.stop
    if fmap.frequencies is not None:
        raw = x[:, list(fmap.rbf_dims)]
        amplitude = math.sqrt(2 * fmap.rbf_variance / len(fmap.phases))
        out.append(0.5 * (a[:, at:] * phi[:, at:]).sum())
        turn = (a[:, at:] * amplitude * np.sin(raw @ fmap.frequencies + fmap.phases)) @ fmap.frequencies.T
        out += (turn * raw).sum(axis=0).tolist()
    return np.array(out)


def step_sums(targets: DataFrame, fmap: FeatureMap, q: Weights, ahead: FeatureMap | None = None) -> dict[str, np.ndarray | float]:
    """One pass at (fmap, q): rows, data bound, kernel gradient, and the natural parameters of the next q.

    ``ahead`` replaces the features of those natural parameters, while moments stay those of ``fmap``.
    """
    dim, n_theta = fmap.dim, len(kernel_values(fmap))
    upper = np.triu_indices(dim)
    n_upper = len(upper[0])

    def per_batch(x, shift, target):
        phi = fmap.transform(x)
        mean, var = _moments(phi, shift, q)
        e = expected_terms(mean, var)
        slope, curve = _derivatives(e, target)
        new = phi if ahead is None else ahead.transform(x)
        gram = (new * curve[:, None]).T @ new
        pull = new.T @ (slope + curve * (mean - shift))
        bound = (target * e["lp1"] + (1 - target) * e["lp0"]).sum()
        return np.concatenate([[len(x), bound], kernel_gradient(x, phi, fmap, q, slope, curve), gram[upper], pull])

    flat = _summed(targets, 2 + n_theta + n_upper + dim, per_batch)
    gram = np.zeros((dim, dim))
    gram[upper] = flat[2 + n_theta : 2 + n_theta + n_upper]
    return {
        "n": flat[0], "bound": flat[1], "theta": flat[2 : 2 + n_theta],
        "precision": gram + np.triu(gram, 1).T + np.eye(dim), "shift": flat[2 + n_theta + n_upper :],
    }


def data_bounds(targets: DataFrame, candidates: Sequence[tuple[FeatureMap, Weights]]) -> np.ndarray:
    """Expected log prior of the soft labels under each candidate, all in one pass."""

    def per_batch(x, shift, target):
        out = []
        for fmap, q in candidates:
            e = expected_terms(*_moments(fmap.transform(x), shift, q))
            out.append((target * e["lp1"] + (1 - target) * e["lp0"]).sum())
        return np.array(out)

    return _summed(targets, len(candidates), per_batch)


class KernelSteps:
    """Step lengths in log theta: a fixed rate per row, or one length per parameter that follows the gradient's sign."""

    def __init__(self, n: int, rate: float | None, first: float = 0.2):
        self.rate, self.length, self.sign = rate, np.full(n, first), np.zeros(n)

    def propose(self, fmap: FeatureMap, sums: dict) -> FeatureMap:
        theta = kernel_values(fmap)
        slope = sums["theta"] - theta
        if self.rate is not None:
            step = np.clip(self.rate * slope / sums["n"], -MAX_LOG_STEP, MAX_LOG_STEP)
        else:
            sign = np.sign(slope)
            self.length = np.clip(np.where(sign * self.sign < 0, self.length / 2, self.length), 1e-4, MAX_LOG_STEP)
            self.sign, step = sign, sign * self.length
        return with_kernel_values(fmap, np.exp(np.log(theta) + step))

    def judged(self, accepted: bool) -> None:
        self.length = np.clip(self.length * (1.3 if accepted else 0.4), 1e-4, MAX_LOG_STEP)


def raise_bound(targets: DataFrame, fmap: FeatureMap, q: Weights, steps: KernelSteps | None, search: bool) -> tuple[FeatureMap, Weights]:
    """One step of q(w) and, with ``steps``, of the kernel; with ``search`` the bound never falls."""
    here = step_sums(targets, fmap, q)
    options: list[tuple[FeatureMap, Weights]] = [(fmap, Weights.from_natural(here["precision"], here["shift"]))]
    if steps is not None and here["n"]:
        ahead = steps.propose(fmap, here)
        moved = step_sums(targets, fmap, q, ahead)
        options.append((ahead, Weights.from_natural(moved["precision"], moved["shift"])))
    if not search:
        return options[-1]
    before = spd_inverse_logdet(q.cov)[0]
    half = Weights.from_natural((before + here["precision"]) / 2, ((before * q.mean).sum(axis=1) + here["shift"]) / 2)
    options.append((fmap, half))
    values = data_bounds(targets, options)
    totals = [v - w.divergence() + kernel_log_prior(m) for v, (m, w) in zip(values, options)]
    best = int(np.argmax(totals))
    if steps is not None and here["n"]:
        steps.judged(best == 1)
    if totals[best] < here["bound"] - q.divergence() + kernel_log_prior(fmap):
        return fmap, q
    return options[best]


def variational_prior(
    ann: DataFrame,
    features: DataFrame,
    dims: dict[str, list[int]],
    model: WorkerModel,
    rounds: int = 20,
    threshold: float | None = 1e-5,
    learn_kernel: bool = True,
    kernel_rate: float | None = None,
    search: bool = True,
    weight_steps: int = 1,
    dedupe: str = "max",
    mean_function: str = "zero",
    offset: str = "logit",
    mean_model=None,
    fourier: int = 64,
    lengthscales: Sequence[float] | None = None,
    variance: float = 1.0,
    seed: int = 0,
    rows_per_part: int = skew.ROWS_PER_PART,
    gold: DataFrame | None = None,
    ref_params: dict[str, DataFrame] | None = None,
    logging_freq: int | None = None,
) -> PriorFit:
    """Crowd labels with q(z), q(w), worker parameters and kernel parameters fitted to one bound.

    ``kernel_rate`` fixes the step of the kernel per row instead of adapting it; without ``search`` every step is taken.
    The trace holds the bound after each E-step and the kernel parameters of the round and, every ``logging_freq``
    rounds, label metrics against ``gold`` and errors of the new worker parameters against ``ref_params``.
    """
    scratch = Scratch(ann.sparkSession)
    ann = canonical(ann, dedupe)
    model.k = 2
    layout = Layout(index_labels(ann, [0, 1]), scratch, rows_per_part)
    like = [model.likelihood(t) for t in range(2)]
    columns = step_columns(model)
    monitor = Monitor(scratch, gold, ref_params, logging_freq)
    evidence = [F.sum("evidence").alias("evidence")]
    trace: list[tuple[int, str, float]] = []
    try:
        mean = fit_mean(features, ann, mean_function, offset, mean_model)
        rows = scratch.cut(mean.apply(features), "features")
        fmap = feature_map(features, dims, fourier, lengthscales, variance, seed)
        q = Weights.prior(fmap.dim)
        steps = KernelSteps(len(kernel_values(fmap)), kernel_rate) if learn_kernel else None
        params = scratch.cut(layout.workers().select("worker_id", *[c.alias(n) for n, c in model.init_columns().items()]), "params")
        last = post = f = None
        for t in range(1, rounds + 2):
            for table in (f, post):
                scratch.drop(table)
            f = scratch.cut(latent_terms(rows, fmap, q), "latent")
            new_post = posterior(layout, params, like, None, task_prior=f.select("task_id", "lp0", "lp1"))
            post, seen = watched(lambda table: scratch.cut(table, "posterior"), new_post, evidence)
            bound = float(seen["evidence"] or 0.0) - q.divergence() + kernel_log_prior(fmap)
            trace.append((t - 1, "evidence_bound", bound))
            trace += [(t - 1, f"kernel_{i}", float(v)) for i, v in enumerate(kernel_values(fmap))]
            if t > rounds or (last is not None and relative_change_below(bound, last, threshold)):
                break
            last = bound
            new = scratch.cut(maximise(layout, params, post, model, columns), "params")
            scratch.drop(params)
            params = new
            if monitor.due(t - 1):
                trace += monitor.rows(t, decode(post, [0, 1]), model.worker_table(params))
            targets = scratch.cut(rows.join(post.select("task_id", F.col("g1").alias("target")), "task_id"), "targets")
            for _ in range(weight_steps):
                fmap, q = raise_bound(targets, fmap, q, steps, search)
            scratch.drop(targets)
    finally:
        layout.close()
    out = PriorFit(
        f"variational-{model.name}", decode(post, [0, 1]), model.worker_table(params), None, trace,
        feature_map=fmap, weights=q.mean, covariance=q.cov, predictions=predict(f), mean=mean,
    )
    out.params = params
    return out
