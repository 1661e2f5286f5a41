"""Worker models for :mod:`tallyfold.models.em`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.mathx import digamma
from tallyfold.models.em import Fit, WorkerModel, fit_em
from tallyfold.models.restarts import fit_restarts


def own_posterior(k: int) -> Column:
    """Posterior of the label that was given: g[label]."""
    expr = F.col("g0")
    for i in range(1, k):
        expr = F.when(F.col("label") == i, F.col(f"g{i}")).otherwise(expr)
    return expr


class ConfusionWorker(WorkerModel):
    """One K x K confusion matrix per worker (rows: truth, columns: label)."""

    name = "ds"

    def __init__(self, k: int = 2, init_quality: float = 0.7, smoothing: float = 0.0):
        super().__init__(k)
        self.init_quality = init_quality
        self.smoothing = smoothing

    def _start(self, truth: int, label: int) -> Column:
        q = self.init_quality
        return F.lit(float(q if truth == label else (1 - q) / (self.k - 1)))

    def init_columns(self) -> dict[str, Column]:
        rows = [F.array(*[self._start(t, y) for y in range(self.k)]) for t in range(self.k)]
        return {"cm": F.array(*rows)}

    def likelihood(self, truth: int) -> Column:
        return F.col("cm")[truth][F.col("label")]

    def m_step_aggs(self) -> list[Column]:
        k = self.k
        mass = [F.sum(f"g{t}").alias(f"n_{t}") for t in range(k)]
        cells = [
            F.sum(F.when(F.col("label") == y, F.col(f"g{t}")).otherwise(F.lit(0.0))).alias(f"c_{t}_{y}")
            for t in range(k)
            for y in range(k)
        ]
        return mass + cells

    def m_step_columns(self) -> dict[str, Column]:
        k, a = self.k, self.smoothing

        def cell(t: int, y: int) -> Column:
            n = F.col(f"n_{t}") + k * a
            return F.when(n > 0, (F.col(f"c_{t}_{y}") + a) / n).otherwise(self._start(t, y))

        return {"cm": F.array(*[F.array(*[cell(t, y) for y in range(k)]) for t in range(k)])}

    def worker_table(self, params: DataFrame) -> DataFrame:
        truth = params.select("worker_id", F.posexplode("cm").alias("truth", "row"))
        return truth.select("worker_id", "truth", F.posexplode("row").alias("label", "p"))


class OneCoinWorker(WorkerModel):
    """One competence per worker."""

    name = "zc"
    warmup = 1

    def __init__(self, k: int = 2, init_competence: float = 0.8, pseudo: float = 0.0):
        super().__init__(k)
        self.init_competence = init_competence
        self.pseudo = pseudo

    def init_columns(self) -> dict[str, Column]:
        return {"competence": F.lit(float(self.init_competence))}

    def likelihood(self, truth: int) -> Column:
        w = F.col("competence")
        return F.when(F.col("label") == truth, w).otherwise((F.lit(1.0) - w) / F.lit(float(self.k - 1)))

    def m_step_aggs(self) -> list[Column]:
        return [F.sum(own_posterior(self.k)).alias("right"), F.count("*").alias("n")]

    def m_step_columns(self) -> dict[str, Column]:
        a = self.pseudo
        return {"competence": (F.col("right") + a) / (F.col("n") + 2 * a)}

    def worker_table(self, params: DataFrame) -> DataFrame:
        return params.select("worker_id", "competence")


class SpammerWorker(WorkerModel):
    """Copies the truth or, with some probability, draws from a private label distribution.

    ``variational`` replaces the ratios of the M-step by exp(psi - psi) weights.
    """

    name = "mace"
    m_step_reads_params = True

    def __init__(
        self,
        k: int = 2,
        alpha: float = 0.5,
        beta: float = 0.5,
        delta: float = 0.01,
        variational: bool = False,
        init_spamming: float = 0.5,
    ):
        super().__init__(k)
        self.alpha, self.beta, self.delta = alpha, beta, delta
        self.variational = variational
        self.init_spamming = init_spamming

    def init_columns(self) -> dict[str, Column]:
        return {
            "spamming": F.lit(float(self.init_spamming)),
            "copying": F.lit(1.0 - self.init_spamming),
            "strategy": F.array(*[F.lit(1.0 / self.k)] * self.k),
        }

    def likelihood(self, truth: int) -> Column:
        spam = F.col("spamming") * F.col("strategy")[F.col("label")]
        return F.when(F.col("label") == truth, F.col("copying") + spam).otherwise(spam)

    def _spam_mass(self) -> Column:
        """Expected share of this annotation that was spam."""
        g = own_posterior(self.k)
        spam = F.col("spamming") * F.col("strategy")[F.col("label")]
        as_spam = F.coalesce(F.try_divide(spam, F.col("copying") + spam), F.lit(1.0))
        return g * as_spam + (F.lit(1.0) - g)

    def m_step_aggs(self) -> list[Column]:
        mass = self._spam_mass()
        return [
            F.count("*").alias("n"),
            F.sum(mass).alias("spam"),
            *[
                F.sum(F.when(F.col("label") == y, mass).otherwise(F.lit(0.0))).alias(f"spam_{y}")
                for y in range(self.k)
            ],
        ]

    def m_step_columns(self) -> dict[str, Column]:
        a, b, d, k = (float(v) for v in (self.alpha, self.beta, self.delta, self.k))
        n, spam = F.col("n").cast("double"), F.col("spam")
        if self.variational:

            def ratio(x: Column, total: Column) -> Column:
                return F.exp(digamma(x) - digamma(total))
        else:

            def ratio(x: Column, total: Column) -> Column:
                return x / total

        return {
            "spamming": ratio(spam + a, n + (a + b)),
            "copying": ratio(n - spam + b, n + (a + b)),
            "strategy": F.array(
                *[ratio(F.col(f"spam_{y}") + d, spam + d * k) for y in range(self.k)]
            ),
        }

    def worker_table(self, params: DataFrame) -> DataFrame:
        s, c = F.col("spamming"), F.col("copying")
        return params.select("worker_id", (c / (s + c)).alias("competence"), "spamming", "strategy")


def dawid_skene(ann: DataFrame, init_quality: float = 0.7, **kw) -> Fit:
    return fit_em(ann, ConfusionWorker(init_quality=init_quality), **kw)


def one_coin(ann: DataFrame, **kw) -> Fit:
    return fit_em(ann, OneCoinWorker(), **kw)


def mace(
    ann: DataFrame,
    alpha: float = 0.5,
    beta: float = 0.5,
    rounds: int = 100,
    threshold: float | None = None,
    variational: bool = True,
    dedupe: str = "max",
    restarts: int = 1,
    **kw,
) -> Fit:
    """Spammer model: adds the entropy of every task; the score is the hard label.

    With ``restarts`` above 1 that many starts share the passes and the likeliest one is returned.
    """
    model = SpammerWorker(alpha=alpha, beta=beta, variational=variational)
    common = {"rounds": rounds, "threshold": threshold, "dedupe": dedupe, **kw}
    if restarts > 1:
        fit = fit_restarts(ann, model, restarts, **common)
    else:
        fit = fit_em(ann, model, learn_prior=False, start_posterior="votes", **common)
    entropy = -F.aggregate(
        "p", F.lit(0.0), lambda acc, p: acc + F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))
    )
    fit.tasks = fit.labels.select("task_id", entropy.alias("entropy"))
    fit.labels = fit.labels.withColumn("score", F.col("label").cast("double"))
    return fit
