"""Which tasks to label next: acquisition scores over a predictive mean and variance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.constants import JITTER
from tallyfold.functions.mathx import dlit, norm_cdf, norm_pdf
from tallyfold.operators.ranking import top_k


def _floored_sd(var: Column) -> Column:
    return F.sqrt(F.greatest(var, dlit(JITTER)))


def expected_improvement(mean: Column, var: Column) -> Column:
    sd = _floored_sd(var)
    z = mean / sd
    return mean * norm_cdf(z) + sd * norm_pdf(z)


def probability_of_improvement(mean: Column, var: Column) -> Column:
    return norm_cdf(mean / _floored_sd(var))


def ucb_beta(n_rows: int) -> float:
    """Exploration weight; grows with the number of candidates."""
    xi, delta = 0.2, 0.1
    return 2 * xi * math.log(math.pi**2 / (3 * delta)) + xi * (4 + n_rows) * math.log(n_rows + 1)


def upper_confidence_bound(mean: Column, var: Column, n_rows: int) -> Column:
    return mean + F.sqrt(dlit(ucb_beta(n_rows)) * var)


def acquisition_scores(pred: DataFrame) -> DataFrame:
    """Add ``ei``, ``pi`` and ``ucb`` to a table with ``mean`` and ``var``."""
    n = pred.count()
    m, v = F.col("mean"), F.col("var")
    return (
        pred.withColumn("ei", expected_improvement(m, v))
        .withColumn("pi", probability_of_improvement(m, v))
        .withColumn("ucb", upper_confidence_bound(m, v, n))
    )


def next_tasks(scored: DataFrame, k: int, score: str = "ei") -> DataFrame:
    return top_k(scored, score, k, "task_id")
