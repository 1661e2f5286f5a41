"""Annotation statistics and profile-based filters.

Statistics are joined back as aggregated tables rather than computed by
``Window.partitionBy``: a window would gather every row of a hot task or worker
in one task, whereas the aggregate combines map-side and the join-back splits
hot keys, which the counts already name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.constants import NON_RELEVANT, RELEVANT
from tallyfold.operators import skew
from tallyfold.operators.annotations import correct_label, gold_labels


def task_accuracy(df: DataFrame) -> DataFrame:
    return df.groupBy("task_id").agg(F.avg(correct_label()).alias("task_acc"))


def worker_accuracy(df: DataFrame) -> DataFrame:
    return df.groupBy("worker_id").agg(F.avg(correct_label()).alias("worker_acc"))


def task_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("task_id").agg(F.count("label").alias("task_anno_num"))


def worker_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("worker_id").agg(F.count("label").alias("worker_anno_num"))


def _join_back(df: DataFrame, stats: DataFrame, key: str, by: str, count: str, rows_per_part: int) -> DataFrame:
    """Statistics back to rows; hot keys, known from the counts, are split by ``by``."""
    hot = skew.hot_from_counts(stats, key, count, rows_per_part)
    return skew.skew_safe_join(df, stats, key, by, hot=hot)


def with_counts(df: DataFrame, rows_per_part: int = skew.ROWS_PER_PART) -> DataFrame:
    out = _join_back(df, task_counts(df), "task_id", "worker_id", "task_anno_num", rows_per_part)
    return _join_back(out, worker_counts(df), "worker_id", "task_id", "worker_anno_num", rows_per_part)


def with_profile(df: DataFrame, rows_per_part: int = skew.ROWS_PER_PART) -> DataFrame:
    """Every row with accuracy and count of its task and of its worker."""
    per_task = df.groupBy("task_id").agg(
        F.avg(correct_label()).alias("task_acc"), F.count("label").alias("task_anno_num")
    )
    per_worker = df.groupBy("worker_id").agg(
        F.avg(correct_label()).alias("worker_acc"), F.count("label").alias("worker_anno_num")
    )
    out = _join_back(df, per_task, "task_id", "worker_id", "task_anno_num", rows_per_part)
    return _join_back(out, per_worker, "worker_id", "task_id", "worker_anno_num", rows_per_part)


def profile_filter(
    df: DataFrame,
    task_acc: tuple[float, float] | None = None,
    task_anno_num: tuple[float, float] | None = None,
    worker_acc: tuple[float, float] | None = None,
    worker_anno_num: tuple[float, float] | None = None,
) -> DataFrame:
    """Keep rows whose statistics of the unfiltered table lie in ``[lo, hi)``."""
    ranges = {
        "task_acc": task_acc,
        "task_anno_num": task_anno_num,
        "worker_acc": worker_acc,
        "worker_anno_num": worker_anno_num,
    }
    wanted = {name: r for name, r in ranges.items() if r is not None}
    if not wanted:
        return df
    out = with_profile(df)
    for name, (lo, hi) in wanted.items():
        out = out.filter((F.col(name) >= lo) & (F.col(name) < hi))
    return out


def _stratum(count: Column, edges: tuple[float, ...]) -> Column:
    expr = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        expr = F.when((count > edges[i]) & (count <= edges[i + 1]), i).otherwise(expr)
    return expr


def count_strata(
    df: DataFrame,
    task_edges: tuple[float, ...] = (0, 5, math.inf),
    worker_edges: tuple[float, ...] = (0, 5, math.inf),
) -> DataFrame:
    """Rows with their stratum numbers ``t`` and ``a`` (left-open ranges, the last one without end).

    Only rows outside the given edges drop: by default those of a task or worker without any label that is not null.
    """
    return (
        with_counts(df)
        .withColumn("t", _stratum(F.col("task_anno_num"), task_edges))
        .withColumn("a", _stratum(F.col("worker_anno_num"), worker_edges))
        .filter(F.col("t").isNotNull() & F.col("a").isNotNull())
    )


def dataset_statistics(df: DataFrame) -> DataFrame:
    """One row: #tasks, #workers, #judgements, #relevant, #non-relevant."""
    rows = df.agg(
        F.countDistinct("worker_id").alias("worker_num"),
        F.countDistinct("task_id", "worker_id").alias("judgement_num"),
    )
    gold = gold_labels(df).agg(
        F.count("*").alias("task_num"),
        F.sum((F.col("gold") == RELEVANT).cast("long")).alias("rel_num"),
        F.sum((F.col("gold") == NON_RELEVANT).cast("long")).alias("nonrel_num"),
    )
    return one_row(gold, rows)


def one_row(*parts: DataFrame) -> DataFrame:
    """Put several one-row tables side by side (union and fold; no cross join)."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def task_difficulty(df: DataFrame) -> DataFrame:
    """1 - share of correct labels per task."""
    return df.groupBy("task_id").agg((1 - F.avg(correct_label())).alias("task_difficulty"))


def worker_competence(df: DataFrame) -> DataFrame:
    return df.groupBy("worker_id").agg(F.avg(correct_label()).alias("worker_competence"))


def label_quality(df: DataFrame) -> DataFrame:
    """Mean and sample deviation of per-task and of per-worker accuracy, in one row."""
    per_task = task_accuracy(df).agg(
        F.avg("task_acc").alias("task_mean"), F.stddev_samp("task_acc").alias("task_std")
    )
    per_worker = worker_accuracy(df).agg(
        F.avg("worker_acc").alias("worker_mean"), F.stddev_samp("worker_acc").alias("worker_std")
    )
    return one_row(per_task, per_worker)


def crowd_features(ann: DataFrame) -> DataFrame:
    """Mean, population deviation, median, max and min of a task's labels."""
    return ann.groupBy("task_id").agg(
        F.avg("label").alias("label_mean"),
        F.stddev_pop("label").alias("label_std"),
        label_median().alias("label_median"),
        F.max("label").cast("double").alias("label_max"),
        F.min("label").cast("double").alias("label_min"),
    )


def label_median() -> Column:
    """Exact median; labels are few-valued, so the buffer is a small value->count map."""
    return F.percentile("label", F.lit(0.5))


def answer_export(df: DataFrame) -> DataFrame:
    """Distinct (question, worker, answer), globally sorted."""
    return (
        df.select(
            F.col("task_id").alias("question"),
            F.col("worker_id").alias("worker"),
            F.col("label").alias("answer"),
        )
        .distinct()
        .orderBy("question", "worker", "answer")
    )


def truth_export(df: DataFrame) -> DataFrame:
    """Distinct (question, truth), globally sorted."""
    return (
        df.select(F.col("task_id").alias("question"), F.col("gold").alias("truth"))
        .distinct()
        .orderBy("question", "truth")
    )
