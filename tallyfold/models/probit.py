"""Feature-prior crowd model: a probit prior on the true label, any worker model.

    z_i ~ Bernoulli(Phi(f_i)),   f_i = m(x_i) + phi(x_i) . w,   w ~ N(0, I)

``phi`` is an explicit feature map: random Fourier features for the RBF block
and scaled raw values for the linear block, so the kernels are sums over D
columns and every fit is D x D.  Here RBF lengthscales are chosen (inter-quartile
range or given) and the posterior of w is a Laplace approximation;
:mod:`tallyfold.models.variational` learns kernel parameters and a variational posterior.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.constants import JITTER
from tallyfold.functions.mathx import np_norm_cdf, np_norm_pdf, probit_link
from tallyfold.models.em import (
    Fit,
    Layout,
    Monitor,
    WorkerModel,
    decode,
    index_labels,
    maximise,
    posterior,
    relative_change_below,
    step_columns,
)
from tallyfold.models.majority import majority_vote
from tallyfold.models.supervised import binary_probability, training_table
from tallyfold.operators import skew
from tallyfold.operators.annotations import canonical
from tallyfold.operators.evaluation import to_class
from tallyfold.session import Scratch, watched

MAX_DIM = 512


@dataclass
class FeatureMap:
    """Fourier weights and scales of the explicit kernel map."""

    linear_dims: Sequence[int]
    rbf_dims: Sequence[int]
    linear_variance: float = 1.0
    rbf_variance: float = 1.0
    lengthscales: Sequence[float] = ()
    frequencies: np.ndarray | None = None
    phases: np.ndarray | None = None

    @property
    def dim(self) -> int:
        fourier = 0 if self.frequencies is None else len(self.phases)
        return 1 + len(self.linear_dims) + fourier

    def rescaled(self, linear_variance: float, rbf_variance: float, lengthscales: Sequence[float]) -> FeatureMap:
        """The same random draws under other kernel parameters."""
        freq = self.frequencies
        if freq is not None:
            freq = freq * (np.asarray(self.lengthscales, float) / np.asarray(lengthscales, float))[:, None]
        return FeatureMap(
            self.linear_dims, self.rbf_dims, linear_variance, rbf_variance, [float(v) for v in lengthscales], freq, self.phases
        )

    def transform(self, x: np.ndarray) -> np.ndarray:
        """Rows of raw features to rows of phi (bias first)."""
        parts = [np.ones((len(x), 1))]
        if self.linear_dims:
            parts.append(math.sqrt(self.linear_variance) * x[:, list(self.linear_dims)])
        if self.frequencies is not None:
            z = x[:, list(self.rbf_dims)] @ self.frequencies + self.phases
            parts.append(math.sqrt(2 * self.rbf_variance / len(self.phases)) * np.cos(z))
        return np.hstack(parts)


def feature_map(
    features: DataFrame,
    dims: dict[str, list[int]],
    fourier: int = 64,
    lengthscales: Sequence[float] | None = None,
    variance: float = 1.0,
    seed: int = 0,
) -> FeatureMap:
    """Kernel layout: RBF on ``dims['rbf']``, linear on ``dims['linear']``, sum of both.

    Without ``lengthscales`` each RBF dimension uses its inter-quartile range
    (1 when that is zero).
    """
    rbf, linear = list(dims.get("rbf", [])), list(dims.get("linear", []))
    if not rbf and not linear:
        raise ValueError("no kernel dimension given")
    size = 1 + len(linear) + (fourier if rbf else 0)
    if size > MAX_DIM:
        raise ValueError(f"feature map has {size} columns; the limit is {MAX_DIM}")
    if not rbf:
        return FeatureMap(linear, [], linear_variance=variance)
    if lengthscales is None:
        exprs = [F.percentile_approx(F.col("features")[i], [0.25, 0.75]).alias(f"q{i}") for i in rbf]
        row = features.agg(*exprs).first()
        lengthscales = [max(float(q[1] - q[0]), 0.0) or 1.0 for q in row]
    rng = np.random.default_rng(seed)
    freq = rng.standard_normal((len(rbf), fourier)) / np.asarray(lengthscales, dtype=float)[:, None]
    phase = rng.uniform(0, 2 * math.pi, fourier)
    return FeatureMap(linear, rbf, variance, variance, list(lengthscales), freq, phase)


def mapped(features: DataFrame, fmap: FeatureMap) -> DataFrame:
    """``(task_id, phi)``, Arrow batches in, Arrow batches out."""
    keep = [f for f in features.schema.fields if f.name not in ("features",)]
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in keep], "phi array<double>"])
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = pdf[names].copy()
                out["phi"] = list(fmap.transform(np.vstack(pdf["features"].to_numpy()).astype(float)))
                yield out

    return features.mapInPandas(run, schema)


def _gram_rows(dim: int, weights: np.ndarray):
    """Per-partition sums of the probit Fisher matrix (upper triangle) and gradient."""
    upper = np.triu_indices(dim)
    n_upper = len(upper[0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, grad, seen = np.zeros((dim, dim)), np.zeros(dim), 0
        for pdf in batches:
            if not len(pdf):
                continue
            seen += len(pdf)
            phi = np.vstack(pdf["phi"].to_numpy()).astype(float)
            target = pdf["target"].to_numpy(float)
            f = phi @ weights + pdf["shift"].to_numpy(float)
            p = np_norm_cdf(f) * (1 - 2 * JITTER) + JITTER
            slope = np_norm_pdf(f) * (1 - 2 * JITTER)
            grad += phi.T @ (slope * (target / p - (1 - target) / (1 - p)))
            gram += (phi * (slope * slope / (p * (1 - p)))[:, None]).T @ phi
        if seen:
            yield pd.DataFrame(
                {"k": np.arange(n_upper + dim), "v": np.concatenate([gram[upper], grad])}
            )

    return run


def spd_inverse(a: np.ndarray) -> np.ndarray:
    return spd_inverse_logdet(a)[0]


def spd_inverse_logdet(a: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant of a small symmetric positive definite matrix by elimination.

    Plain array arithmetic: a multi-threaded LAPACK call can stall in a driver
    process that has forked (as launching the JVM does).
    """
    a = np.array(a, dtype=float)
    logdet = 0.0
    for i in range(len(a)):
        pivot = a[i, i]
        logdet += math.log(pivot)
        row, col = a[i] / pivot, a[:, i].copy()
        a -= np.outer(col, row)
        a[i], a[:, i] = row, -col / pivot
        a[i, i] = 1.0 / pivot
    return a, logdet


def newton_probit(rows: DataFrame, dim: int, weights: np.ndarray | None = None, steps: int = 3):
    """Fisher-scoring steps for soft targets; returns weights and covariance.

    ``rows(phi, shift, target)``.  Each partition reduces to D(D+3)/2 numbers,
    Spark sums them by position, and only that sum (D <= 512) reaches the driver.
    """
    weights = np.zeros(dim) if weights is None else np.asarray(weights, dtype=float)
    upper = np.triu_indices(dim)
    n_upper = len(upper[0])
    cov = np.eye(dim)
    for _ in range(steps):
        sums = (
            rows.select("phi", "shift", "target")
            .mapInPandas(_gram_rows(dim, weights), "k long, v double")
            .groupBy("k")
            .agg(F.sum("v").alias("v"))
        )
        flat = np.zeros(n_upper + dim)
        got = sums.toPandas()
        flat[got["k"].to_numpy()] = got["v"].to_numpy()
        gram = np.zeros((dim, dim))
        gram[upper] = flat[:n_upper]
        gram = gram + np.triu(gram, 1).T + np.eye(dim)
        cov = spd_inverse(gram)
        weights = weights + (cov * (flat[n_upper:] - weights)).sum(axis=1)
    return weights, cov


def latent(phi_rows: DataFrame, weights: np.ndarray, cov: np.ndarray) -> DataFrame:
    """Mean and variance of f per row: ``shift + phi . w`` and ``phi' C phi``."""
    keep = [f for f in phi_rows.schema.fields if f.name not in ("phi", "shift")]
    names = [f.name for f in keep]
    schema = ", ".join(
        [*[f"{f.name} {f.dataType.simpleString()}" for f in keep], "f_mean double", "f_var double"]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                phi = np.vstack(pdf["phi"].to_numpy()).astype(float)
                out = pdf[names].copy()
                out["f_mean"] = phi @ weights + pdf["shift"].to_numpy(float)
                out["f_var"] = np.einsum("ij,jk,ik->i", phi, cov, phi, optimize=True)
                yield out

    return phi_rows.mapInPandas(run, schema)


def predictive(f_mean: Column, f_var: Column) -> tuple[Column, Column]:
    """Mean and variance of the label under f ~ N(f_mean, f_var)."""
    from tallyfold.functions.mathx import norm_cdf

    p = norm_cdf(f_mean / F.sqrt(F.lit(1.0) + f_var))
    return p, p - p * p


def predict(latent_rows: DataFrame) -> DataFrame:
    """``(task_id, mean, var, label)`` from latent means and variances."""
    p, v = predictive(F.col("f_mean"), F.col("f_var"))
    return latent_rows.select("task_id", p.alias("mean"), v.alias("var"), to_class(p, 0.5).alias("label"))


@dataclass
class MeanFunction:
    """A fitted mean function m(x); ``model`` is None for the zero mean."""

    kind: str = "zero"
    offset: str = "logit"
    model: object = None

    def apply(self, features: DataFrame) -> DataFrame:
        """``(task_id, features, shift)``."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        if self.model is None:
            return features.select("task_id", "features", F.lit(0.0).alias("shift"))
        vec = features.withColumn("x", array_to_vector(F.col("features").cast("array<double>")))
        if self.kind == "linear":
            return self.model.transform(vec).select("task_id", "features", "shift")
        if self.kind == "logistic":
            scored, p = vec, binary_probability(self.model, F.col("x"))
        else:
            scored, p = self.model.transform(vec), vector_to_array(F.col(self.model.getProbabilityCol()))[1]
        p = F.greatest(F.least(p, F.lit(1 - JITTER)), F.lit(JITTER))
        shift = F.ln(p) if self.offset == "log_proba" else F.ln(p / (F.lit(1.0) - p))
        return scored.select("task_id", "features", shift.alias("shift"))


def fit_mean(
    features: DataFrame,
    ann: DataFrame,
    kind: str = "zero",
    offset: str = "logit",
    model=None,
) -> MeanFunction:
    """``zero``; ``linear`` (least squares on centred majority labels);
    ``logistic`` (regression on majority labels with penalty 1 / n on unscaled
    features, ``offset`` logit or log probability); ``pretrained`` (a fitted
    pyspark.ml classifier as ``model``).
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    if kind == "zero":
        return MeanFunction()
    if kind == "pretrained":
        return MeanFunction(kind, offset, model)
    vec = features.withColumn("x", array_to_vector(F.col("features").cast("array<double>")))
    train = vec.join(majority_vote(ann), "task_id").select("x", F.col("label").cast("double").alias("y"))
    if kind == "linear":
        centred = train.withColumn("y", F.col("y") * 2 - 1)
        fitted = LinearRegression(featuresCol="x", labelCol="y", regParam=1e-3, predictionCol="shift").fit(centred)
    elif kind == "logistic":
        train = training_table(train)
        fitted = LogisticRegression(
            featuresCol="x", labelCol="y", regParam=1.0 / max(1, train.count()), standardization=False, probabilityCol="prob"
        ).fit(train)
    else:
        raise ValueError(f"unknown mean function {kind!r}")
    return MeanFunction(kind, offset, fitted)


def mean_offset(
    features: DataFrame,
    ann: DataFrame,
    kind: str = "zero",
    offset: str = "logit",
    model=None,
) -> DataFrame:
    """Mean function m(x) as ``(task_id, features, shift)``; see :func:`fit_mean`."""
    return fit_mean(features, ann, kind, offset, model).apply(features)


def log_prior_table(latent_rows: DataFrame, prior_power: str = "once", counts: DataFrame | None = None) -> DataFrame:
    """``(task_id, lp0, lp1)``: log prior of both labels from f.

    ``per_label`` multiplies the prior in once per label of the task.
    """
    p = probit_link(F.col("f_mean"))
    out = latent_rows.select(
        "task_id", F.ln(F.lit(1.0) - p).alias("lp0"), F.ln(p).alias("lp1")
    )
    if prior_power == "per_label":
        n = F.coalesce(F.col("n_i"), F.lit(1)).cast("double")
        out = out.join(counts, "task_id", "left").select(
            "task_id", (F.col("lp0") * n).alias("lp0"), (F.col("lp1") * n).alias("lp1")
        )
    return out


@dataclass
class PriorFit(Fit):
    """A :class:`Fit` with the learned prior."""

    feature_map: FeatureMap | None = None
    weights: np.ndarray | None = None
    covariance: np.ndarray | None = None
    predictions: DataFrame | None = None
    mean: MeanFunction = field(default_factory=MeanFunction)

    def predict_new(self, features: DataFrame, shift: Column | None = None) -> DataFrame:
        """Label probabilities of tasks that have features but no annotation.

        The fitted mean function is applied unless ``shift`` replaces it.
        """
        rows = mapped(self.mean.apply(features), self.feature_map)
        if shift is not None:
            rows = rows.withColumn("shift", shift)
        return predict(latent(rows, self.weights, self.covariance))


def feature_prior(
    ann: DataFrame,
    features: DataFrame,
    dims: dict[str, list[int]],
    model: WorkerModel,
    rounds: int = 10,
    threshold: float | None = 1e-4,
    dedupe: str = "max",
    mean_function: str = "zero",
    offset: str = "logit",
    mean_model=None,
    fourier: int = 64,
    lengthscales: Sequence[float] | None = None,
    newton_steps: int = 2,
    prior_power: str = "once",
    freeze: str | None = None,
    start_params: DataFrame | None = None,
    start_weights: np.ndarray | None = None,
    seed: int = 0,
    rows_per_part: int = skew.ROWS_PER_PART,
    gold: DataFrame | None = None,
    ref_params: dict[str, DataFrame] | None = None,
    logging_freq: int | None = None,
) -> PriorFit:
    """EM over (true labels) with a worker M-step and a probit prior M-step.

    ``freeze`` holds one block at its given start: ``"workers"`` (with
    ``start_params``, a table as returned in ``params``) or ``"prior"`` (with
    ``start_weights``).  Every ``logging_freq`` rounds the trace also gets label metrics against ``gold`` and errors
    of the new worker parameters against ``ref_params``; the bound is observed by the job that writes the posterior.
    """
    spark = ann.sparkSession
    scratch = Scratch(spark)
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
        with_shift = mean.apply(features)
        fmap = feature_map(features, dims, fourier, lengthscales, seed=seed)
        phi = scratch.cut(mapped(with_shift, fmap), "phi")
        counts = None
        if prior_power == "per_label":
            counts = scratch.cut(
                layout.by_task(layout.ann, [F.count("*").alias("n_i")], [F.sum("n_i").alias("n_i")]), "counts"
            )
        weights = np.zeros(fmap.dim) if start_weights is None else np.asarray(start_weights, float)
        cov = np.eye(fmap.dim)
        init = [c.alias(n) for n, c in model.init_columns().items()]
        if start_params is not None:
            params = scratch.cut(start_params.select("worker_id", *model.init_columns()), "params")
        else:
            params = scratch.cut(layout.workers().select("worker_id", *init), "params")
        last = None
        for t in range(1, rounds + 1):
            prior = log_prior_table(latent(phi, weights, cov).select("task_id", "f_mean"), prior_power, counts)
            post, seen = watched(
                lambda table: scratch.cut(table, "posterior"), posterior(layout, params, like, None, task_prior=prior), evidence
            )
            bound = float(seen["evidence"])
            trace.append((t, "evidence_bound", bound - 0.5 * float(weights @ weights)))
            if last is not None and relative_change_below(trace[-1][2], last, threshold):
                break
            last = trace[-1][2]
            if freeze != "workers":
                new = scratch.cut(maximise(layout, params, post, model, columns), "params")
                scratch.drop(params)
                params = new
            if monitor.due(t - 1):
                trace += monitor.rows(t, decode(post, [0, 1]), model.worker_table(params))
            if freeze != "prior":
                targets = phi.join(post.select("task_id", F.col("g1").alias("target")), "task_id")
                weights, cov = newton_probit(targets, fmap.dim, weights, newton_steps)
        f = scratch.cut(latent(phi, weights, cov), "latent")
        prior = log_prior_table(f, prior_power, counts)
        post = scratch.cut(posterior(layout, params, like, None, task_prior=prior), "posterior")
    finally:
        layout.close()
    out = PriorFit(
        f"prior-{model.name}", decode(post, [0, 1]), model.worker_table(params), None, trace,
        feature_map=fmap, weights=weights, covariance=cov, predictions=predict(f), mean=mean,
    )
    out.params = params
    return out


def prior_on_votes(
    ann: DataFrame,
    features: DataFrame,
    dims: dict[str, list[int]],
    newton_steps: int = 8,
    mean_function: str = "zero",
    fourier: int = 64,
    lengthscales: Sequence[float] | None = None,
    seed: int = 0,
) -> PriorFit:
    """Probit classifier trained on majority labels."""
    scratch = Scratch(ann.sparkSession)
    ann = canonical(ann, "max")
    votes = majority_vote(ann)
    fmap = feature_map(features, dims, fourier, lengthscales, seed=seed)
    mean = fit_mean(features, ann, mean_function)
    phi = scratch.cut(mapped(mean.apply(features), fmap), "phi")
    targets = phi.join(votes.select("task_id", F.col("label").cast("double").alias("target")), "task_id")
    weights, cov = newton_probit(scratch.cut(targets, "targets"), fmap.dim, None, newton_steps)
    scored = predict(scratch.cut(latent(phi, weights, cov), "latent"))
    labels = scored.select("task_id", "label", F.col("mean").alias("score"))
    return PriorFit(
        "prior-votes", labels, votes.limit(0), None, [],
        feature_map=fmap, weights=weights, covariance=cov, predictions=scored, mean=mean,
    )


def evidence_bound(q: DataFrame, log_lik: DataFrame, log_prior: DataFrame, k: int = 2) -> DataFrame:
    """E_q[log p(labels | z)] - KL(q(z) || p(z | f)) per task.

    ``q(task_id, g0..)``, ``log_lik(task_id, s0..)``, ``log_prior(task_id, lp0..)``.
    """
    rows = q.join(log_lik, "task_id").join(log_prior, "task_id")
    total = F.lit(0.0)
    for i in range(k):
        g = F.col(f"g{i}")
        total = total + F.when(
            g > 0, g * (F.col(f"s{i}") + F.col(f"lp{i}") - F.ln(g))
        ).otherwise(F.lit(0.0))
    return rows.select("task_id", total.alias("bound"))


def log_marginal(log_lik: DataFrame, log_prior: DataFrame, prior_power: str = "once", k: int = 2) -> DataFrame:
    """log p(labels of a task | f): logsumexp over z of log prior + sum of log likelihoods."""
    rows = log_lik.join(log_prior, "task_id")
    times = F.col("n_i").cast("double") if prior_power == "per_label" else F.lit(1.0)
    w = [F.col(f"s{i}") + times * F.col(f"lp{i}") for i in range(k)]
    top = F.greatest(*w)
    total = sum((F.exp(x - top) for x in w[1:]), F.exp(w[0] - top))
    return rows.select("task_id", (top + F.ln(total)).alias("log_p"))
