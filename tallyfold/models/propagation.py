"""Gaussian-probit crowd model by expectation propagation.

    y_ij ~ Phi((f_i + mu_i + mu_j) / sqrt(1 + s_i + s_j)),  mu_i, mu_j ~ N(0, 1),  f_i from N(0, 1) or from features

The unknowns are t_i = f_i + mu_i and mu_j, each with a Gaussian approximation; every annotation owns one Gaussian site
(precision, precision times mean) on its task and one on its worker.  A sweep updates all sites at once: cavities
come from a join with both sides, tilted moments of the probit factor are in closed form, and the new sites, damped,
are added up by task and by worker.  Site precisions are never negative, so no approximation loses its variance.

With features, f_i = m(x_i) + phi(x_i) . w and w ~ N(0, I): the sum of a task's sites is a Gaussian observation of
f_i (its own offset adds unit variance), so the weights follow exactly from D x D sums; what they say about a task is
taken without that task's own observation before the next sweep.

One sweep writes one table of annotations with sites and reads it for two combined aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.constants import JITTER
from tallyfold.functions.mathx import norm_cdf, norm_pdf
from tallyfold.models.em import Fit, Layout, index_labels
from tallyfold.models.probit import PriorFit, feature_map, fit_mean, latent, mapped, predict, spd_inverse
from tallyfold.operators import skew
from tallyfold.operators.annotations import canonical
from tallyfold.operators.evaluation import to_class
from tallyfold.session import Scratch

SITES = ("tt", "tn", "wt", "wn")


def _sweep(layout: Layout, sites: DataFrame, tasks: DataFrame, workers: DataFrame, damping: float) -> DataFrame:
    """New sites.  ``tasks(task_id, tp, th, t_noise)`` and ``workers(worker_id, wp, wh, w_noise)`` hold the natural parameters."""
    rows = layout.with_tasks(layout.with_workers(sites, workers), tasks)
    # cavities: variance and mean of both sides without the site
    rows = rows.selectExpr(
        *sites.columns, "1D / (tp - tt) AS vt", "(th - tn) / (tp - tt) AS mt", "1D / (wp - wt) AS vw", "(wh - wn) / (wp - wt) AS mw",
        "CASE WHEN label = 1 THEN 1D ELSE -1D END AS sign", "1D + t_noise + w_noise AS noise",
    )
    rows = rows.selectExpr("*", "sqrt(noise + vt + vw) AS c").selectExpr("*", "sign * (mt + mw) / c AS z")
    p = norm_cdf(F.col("z")) * (1 - 2 * JITTER) + JITTER
    rows = rows.withColumn("r", norm_pdf(F.col("z")) * (1 - 2 * JITTER) / p)
    rows = rows.selectExpr("*", "greatest(least(r * (r + z), 1D), 0D) / (c * c) AS k", "sign * r / c AS pull")
    keep, new = f"{1.0 - damping!r}D", f"{float(damping)!r}D"
    return rows.selectExpr(
        *[c for c in sites.columns if c not in SITES],
        f"{keep} * tt + {new} * k / (1D - k * vt) AS tt", f"{keep} * tn + {new} * (pull + mt * k) / (1D - k * vt) AS tn",
        f"{keep} * wt + {new} * k / (1D - k * vw) AS wt", f"{keep} * wn + {new} * (pull + mw * k) / (1D - k * vw) AS wn",
    )


def _totals(layout: Layout, sites: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Sums of the sites: ``(task_id, tau, nu)`` and ``(worker_id, tau, nu)``."""
    by_task = layout.by_task(
        sites, [F.sum("tt").alias("tau"), F.sum("tn").alias("nu")], [F.sum("tau").alias("tau"), F.sum("nu").alias("nu")]
    )
    by_worker = sites.groupBy("worker_id").agg(F.sum("wt").alias("tau"), F.sum("wn").alias("nu"))
    return scratch.cut(by_task.select("task_id", "tau", "nu"), "task-sites"), scratch.cut(by_worker, "worker-sites")


class _Sites:
    """The running state: sites, their sums, and the noise variances of both sides."""

    def __init__(self, ann: DataFrame, noise: float, noise_tables: tuple[DataFrame, DataFrame] | None, rows_per_part: int):
        self.scratch = Scratch(ann.sparkSession)
        self.layout = Layout(index_labels(canonical(ann, "max"), [0, 1]), self.scratch, rows_per_part)
        zero = [F.lit(0.0).alias(s) for s in SITES]
        self.sites = self.scratch.cut(self.layout.ann.select("*", *zero), "sites")
        self.by_task, self.by_worker = _totals(self.layout, self.sites, self.scratch)
        self.noise, self.noise_tables = float(noise), noise_tables

    def _with_noise(self, table: DataFrame, key: str, name: str, side: int, given: str) -> DataFrame:
        if self.noise_tables is None:
            return table.withColumn(name, F.lit(self.noise))
        known = self.noise_tables[side].select(key, F.col(given).alias(name))
        return table.join(known, key, "left").fillna(self.noise, [name])

    def workers(self) -> DataFrame:
        return self.by_worker.selectExpr("worker_id", "1D + tau AS wp", "nu AS wh")

    def tasks(self, prior: DataFrame | None) -> DataFrame:
        """Natural parameters of t_i; ``prior(task_id, m, v)`` is that of f_i, N(0, 1) where it has no row."""
        if prior is None:
            return self.by_task.selectExpr("task_id", "0.5D + tau AS tp", "nu AS th")
        joined = self.by_task.join(prior, "task_id", "left").fillna({"m": 0.0, "v": 1.0})
        return joined.selectExpr("task_id", "1D / (1D + v) + tau AS tp", "m / (1D + v) + nu AS th")

    def sweep(self, prior: DataFrame | None, damping: float) -> float:
        """One sweep; returns the largest change of a task's summed site."""
        tasks = self._with_noise(self.tasks(prior), "task_id", "t_noise", 1, "task_var")
        workers = self._with_noise(self.workers(), "worker_id", "w_noise", 0, "worker_var")
        new = self.scratch.cut(_sweep(self.layout, self.sites, tasks, workers, damping), "sites")
        before = (self.sites, self.by_task, self.by_worker)
        self.sites = new
        self.by_task, self.by_worker = _totals(self.layout, new, self.scratch)
        old = before[1].select("task_id", F.col("nu").alias("old"))
        moved = self.by_task.join(old, "task_id").agg(F.max(F.abs(F.col("nu") - F.col("old")))).first()[0]
        for table in before:
            self.scratch.drop(table)
        return float(moved or 0.0)

    def worker_table(self) -> DataFrame:
        return self.scratch.cut(self.workers().selectExpr("worker_id", "wh / wp AS worker_mean", "1D / wp AS worker_var"), "workers")

    def close(self) -> None:
        self.layout.close()


def gaussian_noise_moments(
    ann: DataFrame, noise: float = 0.1, sweeps: int = 20, tolerance: float = 1e-3, damping: float = 0.5,
    noise_tables: tuple[DataFrame, DataFrame] | None = None, rows_per_part: int = skew.ROWS_PER_PART,
) -> Fit:
    """The model without features: label = E f_i >= 0, score = P(f_i >= 0).

    ``noise`` is the variance of every task and worker; ``noise_tables`` (workers with ``worker_var``, tasks with
    ``task_var``, as a gradient fit returns them) gives each its own.
    """
    state = _Sites(ann, noise, noise_tables, rows_per_part)
    trace: list[tuple[int, str, float]] = []
    try:
        for t in range(1, sweeps + 1):
            trace.append((t, "largest_change", state.sweep(None, damping)))
            if trace[-1][2] < tolerance:
                break
        # f and the task's offset share t equally: each has prior variance 1
        tasks = state.tasks(None).selectExpr("task_id", "0.5D * th / tp AS f_mean", "0.5D + 0.25D / tp AS f_var")
        tasks = state.scratch.cut(tasks, "tasks")
        workers = state.worker_table()
    finally:
        state.close()
    score = norm_cdf(F.col("f_mean") / F.sqrt("f_var"))
    labels = tasks.select("task_id", to_class("f_mean", 0.0).alias("label"), score.alias("score"))
    return Fit("noise-moments", labels, workers, tasks, trace)


def gaussian_weights(rows: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of w ~ N(0, I) from observations: ``rows(phi, pull, precision)``, pull = precision times value."""
    upper = np.triu_indices(dim)
    n_upper = len(upper[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(n_upper + dim), False
        for pdf in batches:
            if len(pdf):
                seen = True
                phi = np.vstack(pdf["phi"].to_numpy()).astype(float)
                gram = (phi * pdf["precision"].to_numpy(float)[:, None]).T @ phi
                total += np.concatenate([gram[upper], phi.T @ pdf["pull"].to_numpy(float)])
        if seen:
            yield pd.DataFrame({"k": np.arange(n_upper + dim), "v": total})

    sums = rows.select("phi", "pull", "precision").mapInPandas(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(n_upper + dim)
    flat[sums["k"].to_numpy()] = sums["v"].to_numpy()
    gram = np.zeros((dim, dim))
    gram[upper] = flat[:n_upper]
    cov = spd_inverse(gram + np.triu(gram, 1).T + np.eye(dim))
    return (cov * flat[n_upper:]).sum(axis=1), cov


def noise_prior_moments(
    ann: DataFrame,
    features: DataFrame,
    dims: dict[str, list[int]],
    noise: float = 0.1,
    sweeps: int = 20,
    tolerance: float = 1e-3,
    damping: float = 0.5,
    noise_tables: tuple[DataFrame, DataFrame] | None = None,
    mean_function: str = "zero",
    fourier: int = 64,
    lengthscales: Sequence[float] | None = None,
    seed: int = 0,
    rows_per_part: int = skew.ROWS_PER_PART,
) -> PriorFit:
    """The model with f_i a function of features; every sweep is followed by an exact update of the weights."""
    state = _Sites(ann, noise, noise_tables, rows_per_part)
    scratch = state.scratch
    trace: list[tuple[int, str, float]] = []
    try:
        fmap = feature_map(features, dims, fourier, lengthscales, seed=seed)
        mean = fit_mean(features, ann, mean_function)
        phi = scratch.cut(mapped(mean.apply(features), fmap), "phi")
        weights, cov = np.zeros(fmap.dim), np.eye(fmap.dim)
        # precision of a task's sites as an observation of f, whose own offset adds unit variance
        seen = "tau / (1D + tau)"
        for t in range(1, sweeps + 1):
            f = latent(phi, weights, cov).join(state.by_task, "task_id", "left").fillna(0.0, ["tau", "nu"])
            f = f.selectExpr("task_id", f"1D / f_var - {seen} AS p", "f_mean / f_var - nu / (1D + tau) AS h")
            prior = scratch.cut(f.selectExpr("task_id", "h / p AS m", "1D / p AS v"), "prior")
            trace.append((t, "largest_change", state.sweep(prior, damping)))
            scratch.drop(prior)
            rows = phi.join(state.by_task, "task_id").selectExpr(
                "phi", f"{seen} AS precision", f"nu / (1D + tau) - shift * {seen} AS pull"
            )
            weights, cov = gaussian_weights(rows, fmap.dim)
            if trace[-1][2] < tolerance:
                break
        f = scratch.cut(latent(phi, weights, cov), "latent")
        workers = state.worker_table()
    finally:
        state.close()
    scored = predict(f)
    return PriorFit(
        "prior-noise-moments", scored.select("task_id", "label", F.col("mean").alias("score")), workers, f, trace,
        feature_map=fmap, weights=weights, covariance=cov, predictions=scored, mean=mean,
    )
