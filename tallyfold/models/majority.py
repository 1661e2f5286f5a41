"""Majority vote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.constants import NON_RELEVANT, RELEVANT


def majority_vote(ann: DataFrame) -> DataFrame:
    """Binary vote per task; a tie is relevant, other labels do not vote.

    Map-side combined sums, so a task with very many labels is no heavier than
    any other.  A task appears only if it carries a label.
    """
    votes = ann.groupBy("task_id").agg(
        F.sum((F.col("label") == RELEVANT).cast("long")).alias("n1"),
        F.sum((F.col("label") == NON_RELEVANT).cast("long")).alias("n0"),
    )
    winner = F.when(F.col("n1") >= F.col("n0"), RELEVANT).otherwise(NON_RELEVANT)
    return votes.select("task_id", winner.alias("label"), winner.cast("double").alias("score"))


def plurality_vote(ann: DataFrame) -> DataFrame:
    """Multi-class vote; ties go to the larger label."""
    return (
        ann.groupBy("task_id", "label")
        .agg(F.count("*").alias("n"))
        .groupBy("task_id")
        .agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    )


def require_labels(ann: DataFrame, tasks: DataFrame) -> None:
    """Raise when some task has no label at all."""
    missing = tasks.select("task_id").distinct().join(ann, "task_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("some task has no label")
