"""Run several models on one annotation table and report each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from tallyfold.models.em import Fit
from tallyfold.models.glad import glad
from tallyfold.models.majority import majority_vote
from tallyfold.models.probit import feature_prior, prior_on_votes
from tallyfold.models.propagation import gaussian_noise_moments, noise_prior_moments
from tallyfold.models.sided import gaussian_noise, noise_prior, skill_prior
from tallyfold.models.variational import variational_prior
from tallyfold.models.workers import ConfusionWorker, OneCoinWorker, SpammerWorker, dawid_skene, mace, one_coin
from tallyfold.operators.annotations import canonical
from tallyfold.operators.evaluation import evaluation_report
from tallyfold.session import Scratch, shuffle_partitions

# models fitted side by side; each keeps its arranged labels while it is fitted
AT_ONCE = 3


def majority(ann: DataFrame, **kw) -> Fit:
    return Fit("mv", majority_vote(canonical(ann, "max")), ann.select("worker_id").distinct())


def _with(model) -> Callable[..., Fit]:
    return lambda ann, features, dims, **kw: feature_prior(ann, features, dims, model(), **kw)


PLAIN: dict[str, Callable[..., Fit]] = {
    "mv": majority,
    "ds": dawid_skene,
    "zc": one_coin,
    "glad": glad,
    "mace": mace,
    "likelihood": gaussian_noise,
    "likelihood_moments": gaussian_noise_moments,
}
FEATURE: dict[str, Callable[..., Fit]] = {
    "gpzc": _with(lambda: OneCoinWorker(init_competence=0.7)),
    "gpds": _with(ConfusionWorker),
    "gpmace": _with(SpammerWorker),
    "gpglad": skill_prior,
    "gpcrowd": noise_prior,
    "gpmv": prior_on_votes,
    "gpcrowd_moments": noise_prior_moments,
    "gpzc_variational": lambda ann, features, dims, **kw: variational_prior(ann, features, dims, OneCoinWorker(init_competence=0.7), **kw),
}


def run_model(
    name: str,
    ann: DataFrame,
    features: DataFrame | None = None,
    dims: dict[str, list[int]] | None = None,
    **kw,
) -> Fit:
    """Fit one model by name."""
    if name in PLAIN:
        return PLAIN[name](ann, **kw)
    if name in FEATURE:
        if features is None or dims is None:
            raise ValueError(f"model {name!r} needs features")
        return FEATURE[name](ann, features, dims, **kw)
    raise ValueError(f"unknown model {name!r}")


def prediction_table(fit: Fit, gold: DataFrame) -> DataFrame:
    """``(task_id, gold, pred, score)`` for the evaluation operators."""
    return fit.labels.join(gold, "task_id").select(
        "task_id", "gold", F.col("label").alias("pred"), F.col("score").cast("double").alias("score")
    )


def compare_models(
    ann: DataFrame,
    gold: DataFrame,
    names: Sequence[str],
    features: DataFrame | None = None,
    dims: dict[str, list[int]] | None = None,
    options: dict[str, dict] | None = None,
    at_once: int = AT_ONCE,
) -> DataFrame:
    """One report row per model, in the order of ``names``.

    Gold labels, the labels without repeats and the predictions of a model are written once, since several passes read
    them; the labels lie as they are dealt out by task and worker, so that no model deals them out again to pick one label of
    a worker.  A mean function counts repeated labels as votes, so a model that has one gets all rows.

    ``at_once`` models are fitted side by side: a fit is a chain of short jobs, and one model's jobs fill the slots while
    another's are planned.  An error of one model is raised once the fits under way have ended; no other is begun.
    """
    spark = ann.sparkSession
    scratch, n, cell = Scratch(spark), shuffle_partitions(spark), ["task_id", "worker_id"]
    gold = scratch.cut(gold, "gold")
    once = scratch.cut_by(canonical(ann.repartition(n, *cell), "distinct"), cell, n, "labels")

    def report(name: str) -> DataFrame:
        how = (options or {}).get(name, {})
        fit = run_model(name, ann if how.get("mean_function", "zero") != "zero" else once, features, dims, **how)
        pred = Scratch(spark).cut(prediction_table(fit, gold), "predictions")
        return evaluation_report(pred).select(F.lit(name).alias("model"), "*")

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        under_way = [pool.submit(inheritable_thread_target(spark)(report), name) for name in names]
        try:
            rows = [one.result() for one in under_way]
        finally:
            pool.shutdown(wait=True, cancel_futures=True)
    reports = None
    for row in rows:
        reports = row if reports is None else reports.unionByName(row)
    return reports
