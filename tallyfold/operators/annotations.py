"""Canonical annotation tables: cleaning, keys, duplicate policy, layout changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.constants import NON_RELEVANT, RELEVANT

MAX_MATRIX_WORKERS = 10_000


def binarise(col: str | Column) -> Column:
    """Graded judgement to relevant (> 0) or not."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c > 0, RELEVANT).otherwise(NON_RELEVANT)


def drop_unjudged(df: DataFrame) -> DataFrame:
    """Keep rows whose gold and label are both judged (>= 0)."""
    return df.filter((F.col("gold") >= 0) & (F.col("label") >= 0))


def task_key(topic: str = "topic_id", doc: str = "doc_id") -> Column:
    return F.concat_ws(
        "--", F.trim(F.col(topic).cast("string")), F.trim(F.col(doc).cast("string"))
    )


def correct_label() -> Column:
    return (F.col("gold") == F.col("label")).cast("int")


def labelled_only(df: DataFrame, label: str = "label") -> DataFrame:
    """An unlabelled cell is a NULL label (or simply an absent row)."""
    return df.filter(F.col(label).isNotNull())


def canonical(df: DataFrame, dedupe: str = "distinct", order_by: str | None = None) -> DataFrame:
    """``(task_id, worker_id, label)`` under a duplicate policy.

    ``distinct`` keeps every different label of a (task, worker);
    ``max`` keeps the larger one; ``last_by`` keeps the one with the greatest
    ``order_by`` (ties to the larger label).
    """
    triples = labelled_only(df)
    if dedupe == "distinct":
        return triples.select("task_id", "worker_id", "label").distinct()
    if dedupe == "max":
        picked = F.max("label")
    elif dedupe == "last_by":
        if order_by is None:
            raise ValueError("last_by needs order_by")
        picked = F.max(F.struct(order_by, "label"))["label"]
    else:
        raise ValueError(f"unknown duplicate policy {dedupe!r}")
    return triples.groupBy("task_id", "worker_id").agg(picked.alias("label"))


def gold_labels(df: DataFrame) -> DataFrame:
    """One gold label per task (largest, should a task carry several)."""
    return df.groupBy("task_id").agg(F.max("gold").alias("gold"))


def topic_docs(df: DataFrame) -> DataFrame:
    return df.select("topic_id", "doc_id").distinct()


def topics(df: DataFrame) -> DataFrame:
    return df.select("topic_id").distinct()


def keep_topics(df: DataFrame, wanted: Sequence | DataFrame) -> DataFrame:
    """Rows of the target topics, given as a list of ids or as a table."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select("topic_id").distinct(), "topic_id", "left_semi")
    return df.filter(F.col("topic_id").isin(list(wanted)))


def topic_fold(topic_table: DataFrame, fold: int, k: int, topic_order: Sequence[str] | None = None) -> DataFrame:
    """``(topic_id, part)`` with part train/test.

    The ordered topic list is cut into ``k`` blocks of ``int(n / k)``; block
    ``fold`` trains and everything else tests, remainder topics included.
    Topics are ordered by ``topic_order`` or else by id.
    """
    from tallyfold.operators.ranking import row_numbers

    if not 0 <= fold < k:
        raise ValueError("fold must be in [0, k)")
    if topic_order is not None:
        block = len(topic_order) // k
        train = list(topic_order)[block * fold : block * (fold + 1)]
        in_train = F.col("topic_id").isin(train)
        return topic_table.filter(F.col("topic_id").isin(list(topic_order))).select(
            "topic_id", F.when(in_train, "train").otherwise("test").alias("part")
        )
    distinct_topics = topic_table.select("topic_id").distinct()
    block = distinct_topics.count() // k
    numbered = row_numbers(distinct_topics, [], [F.col("topic_id")], "rn")
    inside = (F.col("rn") > block * fold) & (F.col("rn") <= block * (fold + 1))
    return numbered.select("topic_id", F.when(inside, "train").otherwise("test").alias("part"))


def topics_outside(all_topics: DataFrame, train: DataFrame) -> DataFrame:
    """Test topics: every topic that is not in the training fold."""
    return all_topics.select("topic_id").distinct().join(
        train.select("topic_id").distinct(), "topic_id", "left_anti"
    )


def crowd_matrix(ann: DataFrame, workers: Sequence | None = None) -> DataFrame:
    """Task x worker export, one column per worker, NULL where unlabelled.

    Refused beyond ``MAX_MATRIX_WORKERS`` workers; models never use it.
    """
    if workers is None:
        rows = ann.select("worker_id").distinct().limit(MAX_MATRIX_WORKERS + 1).collect()
        workers = sorted(r[0] for r in rows)
    if len(workers) > MAX_MATRIX_WORKERS:
        raise ValueError("too many workers for a matrix; keep the long form")
    return ann.groupBy("task_id").pivot("worker_id", list(workers)).agg(F.max("label"))


def matrix_to_triples(wide: DataFrame, task_col: str = "task_id") -> DataFrame:
    """Task x worker table with blanks to long-form triples."""
    value_cols = [c for c in wide.columns if c != task_col]
    return (
        wide.unpivot([task_col], value_cols, "worker_id", "label")
        .filter(F.col("label").isNotNull())
        .select(F.col(task_col).alias("task_id"), "worker_id", "label")
    )
