"""Derived quantities of a fitted confusion-matrix model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.models.em import Fit
from tallyfold.operators.annotations import canonical


def q_function(ann: DataFrame, fit: Fit, labels: Sequence[int], dedupe: str = "distinct") -> DataFrame:
    """One row ``q_value``: sum over tasks and truths of posterior * log joint.

    The posterior is the fit's, the parameters are those after its last M-step.
    The data term is a sum over annotations, so it needs one aggregate only.
    """
    k = len(labels)
    wide = fit.workers.groupBy("worker_id").agg(
        *[
            F.max(F.when((F.col("truth") == t) & (F.col("label") == y), F.col("p"))).alias(f"p_{t}_{y}")
            for t in range(k)
            for y in range(k)
        ]
    )
    rows = (
        canonical(ann, dedupe)
        .join(wide, "worker_id")
        .join(fit.labels.select("task_id", F.col("p").alias("g")), "task_id")
    )
    data = F.lit(0.0)
    for t in range(k):
        cell = F.lit(None).cast("double")
        for y in range(k):
            cell = F.when(F.col("label") == int(labels[y]), F.col(f"p_{t}_{y}")).otherwise(cell)
        g = F.col("g")[t]
        data = data + F.when((g > 0) & (cell > 0), g * F.ln(cell)).otherwise(F.lit(0.0))
    shares = fit.labels.agg(*[F.sum(F.col("p")[t]).alias(f"n{t}") for t in range(k)], F.count("*").alias("n"))
    prior = F.lit(0.0)
    for t in range(k):
        prior = prior + F.when(F.col(f"n{t}") > 0, F.col(f"n{t}") * F.ln(F.col(f"n{t}") / F.col("n"))).otherwise(F.lit(0.0))
    parts = rows.agg(F.sum(data).alias("v")).unionAll(shares.select(prior.alias("v")))
    return parts.agg(F.sum("v").alias("q_value"))
