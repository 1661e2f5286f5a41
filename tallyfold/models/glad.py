"""GLAD: worker competence alpha times task easiness exp(beta)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.mathx import dlit, log_sigmoid, sigmoid
from tallyfold.models.ascent import PairModel, ascend, objective, start
from tallyfold.models.conjugate import climb
from tallyfold.models.em import (
    Fit,
    Layout,
    decode,
    index_labels,
    infer_labels,
    label_metrics,
    param_metrics,
    posterior,
    relative_change_below,
)
from tallyfold.models.workers import own_posterior
from tallyfold.operators import skew
from tallyfold.operators.annotations import canonical
from tallyfold.session import Scratch

MAX_LOGIT = 700.0


class GladModel(PairModel):
    """Expected complete log-likelihood Q given the posterior.

    ``prior_strength`` scales standard normal priors centred at 1 on alpha and
    beta; 0 leaves the fit unregularised.
    """

    worker_init = {"alpha": 1.0}
    task_init = {"beta": 1.0}

    def __init__(self, k: int, prior_strength: float = 1.0):
        self.k = k
        self.prior_strength = float(prior_strength)

    @staticmethod
    def logit(p: dict[str, Column]) -> Column:
        raw = p["alpha"] * F.exp(F.least(p["beta"], dlit(MAX_LOGIT)))
        return F.greatest(F.least(raw, dlit(MAX_LOGIT)), dlit(-MAX_LOGIT))

    def row_value(self, p):
        x, g = self.logit(p), own_posterior(self.k)
        wrong = log_sigmoid(-x) - dlit(math.log(self.k - 1))
        return g * log_sigmoid(x) + (dlit(1) - g) * wrong

    def row_gradients(self, p):
        x = self.logit(p)
        slope = own_posterior(self.k) - sigmoid(x)
        easy = F.exp(F.least(p["beta"], dlit(MAX_LOGIT)))
        return {"alpha": slope * easy, "beta": slope * p["alpha"] * easy}

    def row_curvature(self, p):
        x = self.logit(p)
        spread = sigmoid(x) * sigmoid(-x)
        easy = F.exp(F.least(p["beta"], dlit(MAX_LOGIT / 2)))
        return {"alpha": spread * easy * easy, "beta": spread * x * x}

    def penalty(self, name, value):
        return dlit(-0.5 * self.prior_strength) * (value - dlit(1)) * (value - dlit(1))

    def penalty_gradient(self, name, value):
        return dlit(-self.prior_strength) * (value - dlit(1))

    def likelihood(self, truth: int) -> Column:
        x = self.logit({"alpha": F.col("alpha"), "beta": F.col("beta")})
        wrong = sigmoid(-x) / dlit(self.k - 1)
        return F.when(F.col("label") == truth, sigmoid(x)).otherwise(wrong)


def label_prior(labels: Sequence[int], favoured: int) -> list[float]:
    """0.99 shared evenly, 0.01 extra for one label (breaks the symmetry)."""
    k = len(labels)
    return [0.99 / k + (0.01 if y == favoured else 0.0) for y in labels]


def glad(
    ann: DataFrame,
    labels: Sequence[int] | None = None,
    rounds: int = 100,
    threshold: float | None = 1e-4,
    dedupe: str = "distinct",
    favoured: int | None = None,
    prior_strength: float = 1.0,
    inner_steps: int | None = None,
    step_size: float | None = None,
    solver: str | None = None,
    tolerance: float = 0.01,
    gold: DataFrame | None = None,
    ref_params: dict[str, DataFrame] | None = None,
    logging_freq: int | None = None,
    rows_per_part: int = skew.ROWS_PER_PART,
) -> Fit:
    """One (E, M) pass, then rounds of (E, M) until Q settles.

    The M-step maximises Q over (alpha, beta).  ``solver="conjugate"`` (the default unless ``step_size`` is given) takes
    conjugate-gradient steps until no gradient component exceeds ``tolerance``, at most ``inner_steps`` (6: the next
    E-step moves Q more than further steps would; the published fit allows 25); ``"ascent"`` takes ``inner_steps``
    (4) steps along the gradient.
    """
    if solver is None:
        solver = "conjugate" if step_size is None else "ascent"
    if solver not in ("conjugate", "ascent"):
        raise ValueError(f"unknown solver {solver!r}")
    if inner_steps is None:
        inner_steps = 6 if solver == "conjugate" else 4
    spark = ann.sparkSession
    ann = canonical(ann, dedupe)
    if labels is None:
        labels = infer_labels(ann)
    k = len(labels)
    if favoured is None:
        favoured = 1 if 1 in labels else labels[-1]
    prior = label_prior(labels, favoured)
    scratch = Scratch(spark)
    layout = Layout(index_labels(ann, labels), scratch, rows_per_part)
    model = GladModel(k, prior_strength)
    like = [model.likelihood(t) for t in range(k)]
    trace: list[tuple[int, str, float]] = []
    if gold is not None and logging_freq:
        gold = scratch.cut(gold, "gold")
    try:
        workers, tasks = start(layout, scratch, model)
        last_q = None
        for t in range(rounds + 1):
            post = scratch.cut(posterior(layout, workers, like, prior, task_params=tasks), "posterior")
            task_data = post.select("task_id", *[f"g{i}" for i in range(k)])
            before = (workers, tasks)
            if solver == "conjugate":
                workers, tasks, path = climb(layout, scratch, model, workers, tasks, task_data, inner_steps, tolerance, step_size)
                for table in before:
                    scratch.drop(table)
                trace += [(t, "inner_steps", float(len(path) - 1)), (t, "gradient_norm", path[-1].gradient_norm)]
                q = path[-1].objective
            else:
                workers, tasks, values = ascend(layout, scratch, model, workers, tasks, task_data, inner_steps, step_size)
            if threshold is None and not logging_freq:
                continue
            if solver == "ascent":
                # the line search has summed the objective at the point it took
                q = values[-1] if values else objective(layout, model, workers, tasks, task_data)
            q += _prior_term(post, prior)
            trace.append((t, "q", q))
            if t > 0 and last_q is not None and relative_change_below(q, last_q, threshold):
                break
            last_q = q
            if logging_freq and t % logging_freq == 0:
                trace.append((t, "log_likelihood", glad_log_likelihood(layout, model, workers, tasks, prior)))
                if gold is not None:
                    trace += label_metrics(t, decode(post, labels), gold)
                trace += param_metrics(t, workers.withColumnRenamed("alpha", "competence"), ref_params)
                trace += param_metrics(t, tasks.withColumnRenamed("beta", "easiness"), ref_params, "task_id")
        workers = scratch.cut(workers, "workers")
        tasks = scratch.cut(tasks, "tasks")
    finally:
        layout.close()
    total = workers.agg(F.sum("alpha").alias("total")).first()["total"]
    weights = workers.select(
        "worker_id",
        F.col("alpha").alias("competence"),
        F.try_divide(F.col("alpha"), F.lit(float(total))).alias("weight"),
    )
    return Fit(
        "glad",
        decode(post, labels),
        weights,
        tasks.select("task_id", F.col("beta").alias("easiness")),
        trace,
        prior,
    )


def _prior_term(post: DataFrame, prior: Sequence[float]) -> float:
    expr = sum((F.col(f"g{i}") * math.log(p) for i, p in enumerate(prior)), F.lit(0.0))
    return float(post.agg(F.sum(expr)).first()[0])


def glad_log_likelihood(
    layout: Layout, model: GladModel, workers: DataFrame, tasks: DataFrame, prior: Sequence[float]
) -> float:
    """Log evidence plus the standard normal log densities of alpha and beta around 1."""
    like = [model.likelihood(t) for t in range(model.k)]
    value = posterior(layout, workers, like, prior, task_params=tasks).agg(F.sum("evidence")).first()[0]
    for table, col in ((workers, "alpha"), (tasks, "beta")):
        d = F.col(col) - 1
        value += table.agg(F.sum(dlit(-0.5 * math.log(2 * math.pi)) - d * d / 2)).first()[0]
    return float(value)
