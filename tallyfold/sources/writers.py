"""Sinks.  Every writer is a distributed write of a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.textx import clean_text
from tallyfold.models.em import Fit
from tallyfold.operators.evaluation import evaluation_report
from tallyfold.operators.profile import count_strata, label_quality


def write_annotations(df: DataFrame, path: str) -> None:
    df.select("topic_id", "worker_id", "doc_id", "gold", "label").write.csv(path, header=True)


def write_cleaned_texts(df: DataFrame, path: str, key: str = "doc_id") -> None:
    """Cleaned corpus or topics as ``(key, text)`` Parquet."""
    df.select(key, clean_text("text").alias("text")).write.parquet(path)


def write_runs(df: DataFrame, path: str) -> None:
    """One folder per run, six tab-separated columns, rank order within a topic."""
    cols = ["run", "topic_id", "dummy", "doc_id", "rank", "score", "team"]
    ordered = df.select(*cols).repartitionByRange("run", "topic_id", "rank").sortWithinPartitions(
        "run", "topic_id", "rank"
    )
    ordered.write.partitionBy("run").csv(path, sep="\t")


def write_features(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def write_strata(df: DataFrame, path: str) -> None:
    """Annotations split by task and worker counts into ``t=../a=..`` folders."""
    strata = count_strata(df)
    strata.select("topic_id", "worker_id", "doc_id", "gold", "label", "t", "a").write.partitionBy("t", "a").csv(
        path, header=True
    )


def write_results(fit: Fit, gold: DataFrame, path: str) -> None:
    """Metrics as JSON, labels as CSV (task, gold, pred), parameters and trace as JSON."""
    from tallyfold.models.compare import prediction_table

    pred = prediction_table(fit, gold)
    evaluation_report(pred).write.json(f"{path}/eval")
    pred.select("task_id", "gold", "pred").write.csv(f"{path}/pred_labels")
    fit.workers.write.json(f"{path}/workers")
    if fit.tasks is not None:
        fit.tasks.write.json(f"{path}/tasks")
    fit.labels.withColumn("score", F.col("score").cast("double")).write.json(f"{path}/labels")
    if fit.trace_rows:
        fit.trace.write.json(f"{path}/trace")


def write_label_quality(df: DataFrame, path: str) -> None:
    label_quality(df).write.csv(path)
