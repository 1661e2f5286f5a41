"""Scores of predicted labels and parameters against known ones.

Prediction tables are ``(task_id, gold, pred[, score])``; parameter tables are
``(ref, est)`` pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.constants import NON_RELEVANT, RELEVANT
from tallyfold.operators.profile import one_row
from tallyfold.operators.ranking import running_totals
from tallyfold.session import Scratch

RANK_BLOCK_ROWS = 500_000


def to_class(score: str | Column, threshold: float) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c >= F.lit(float(threshold)), RELEVANT).otherwise(NON_RELEVANT)


def _cell(gold: int, pred: int) -> Column:
    hit = (F.col("gold") == gold) & (F.col("pred") == pred)
    return F.coalesce(F.sum(hit.cast("long")), F.lit(0).cast("long"))


def _ratio(num: Column, den: Column) -> Column:
    """num / den as a score: 0 when undefined."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_cells() -> list[Column]:
    """Aggregates tn, fp, fn, tp over ``gold`` and ``pred``."""
    return [_cell(0, 0).alias("tn"), _cell(0, 1).alias("fp"), _cell(1, 0).alias("fn"), _cell(1, 1).alias("tp")]


def confusion(pred: DataFrame) -> DataFrame:
    """One row tn, fp, fn, tp."""
    return pred.agg(*confusion_cells())


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("acc"))


def class_scores(pred: DataFrame) -> DataFrame:
    """Confusion cells, accuracy and precision / recall / F1 of both classes, in one pass."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(pred).select(
        "tn",
        "fp",
        "fn",
        "tp",
        _ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
        _ratio(tp, tp + fp).alias("posi_p"),
        _ratio(tp, tp + fn).alias("posi_r"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("posi_f1"),
        _ratio(tn, tn + fn).alias("nega_p"),
        _ratio(tn, tn + fp).alias("nega_r"),
        _ratio(2 * tn, 2 * tn + fp + fn).alias("nega_f1"),
    )


def auc(pred: DataFrame) -> DataFrame:
    """Area under the ROC curve; tied scores count one half.

    Rows collapse to one per distinct score first, then each score needs only
    the number of negatives below it.
    """
    per_score = (
        pred.filter(F.col("score").isNotNull())
        .groupBy("score")
        .agg(
            F.sum((F.col("gold") == RELEVANT).cast("long")).alias("pos"),
            F.sum((F.col("gold") == NON_RELEVANT).cast("long")).alias("neg"),
        )
    )
    ranked = running_totals(per_score, "score", ["neg"])
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    return ranked.agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def mean_squared_error(pairs: DataFrame) -> DataFrame:
    """Mean squared parameter error; NULL when no parameter can be compared."""
    return pairs.agg(F.avg((F.col("ref") - F.col("est")) * (F.col("ref") - F.col("est"))).alias("mse"))


def pearson(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.corr("ref", "est").alias("rho"))


def _weighted_inversions(rank: np.ndarray, weight: np.ndarray) -> int:
    """Sum of w_i * w_j over i < j with rank_i > rank_j (bitwise, m log m)."""
    total = 0
    if len(rank) < 2:
        return 0
    for bit in range(int(rank.max()).bit_length()):
        # rows that agree above this bit, kept in sequence order
        order = np.argsort(rank >> (bit + 1), kind="stable")
        group = (rank >> (bit + 1))[order]
        one = ((rank >> bit) & 1)[order]
        w = weight[order]
        ones_so_far = np.cumsum(w * one)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        base = np.where(starts > 0, ones_so_far[starts - 1], 0)
        per_row_base = np.repeat(base, np.diff(np.r_[starts, len(group)]))
        zero = one == 0
        total += int(np.sum((w * (ones_so_far - per_row_base))[zero]))
    return total


def _block_inversions(first: list[str], second: list[str]):
    """Per-block counter: order rows by ``first``, count inversions of ``second``."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(first, kind="stable")
        rank = pdf[second[0]].rank(method="dense") if len(second) == 1 else (
            pd.Series(
                np.argsort(np.lexsort([pdf[c].to_numpy() for c in reversed(second)])), index=pdf.index
            )
        )
        inv = _weighted_inversions(rank.to_numpy().astype("int64"), pdf["w"].to_numpy().astype("int64"))
        return pd.DataFrame({"inv": [inv]})

    return count


def kendall_tau(
    pairs: DataFrame, block_rows: int = RANK_BLOCK_ROWS, blocks: int | None = None
) -> DataFrame:
    """Kendall tau-b of (ref, est), exact, without emitting pairs.

    Equal pairs collapse to weighted points.  Points are cut into range blocks
    twice, by (ref, est) and by (est, ref).  A discordant pair then lies either
    in two different blocks both ways (counted from the block x block table), or
    in one est-block, or in one ref-block but different est-blocks; the last two
    are counted inside the block by an m log m inversion count.  Because both
    orders break ties by the other value, hot values are split across blocks and
    tied pairs are never inversions.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark)
    points = scratch.cut(
        pairs.filter(F.col("ref").isNotNull() & F.col("est").isNotNull())
        .groupBy("ref", "est")
        .agg(F.count("*").alias("w")),
        "points",
    )
    n_points = points.count()
    if blocks is None:
        blocks = max(1, -(-n_points // block_rows))
    by_ref = scratch.cut(
        points.repartitionByRange(blocks, "ref", "est").withColumn("p", F.spark_partition_id()), "by-ref"
    )
    cells = scratch.cut(
        by_ref.repartitionByRange(blocks, "est", "ref").withColumn("q", F.spark_partition_id()), "by-both"
    )
    same_q = cells.groupBy("q").applyInPandas(_block_inversions(["ref", "est"], ["est", "ref"]), "inv long")
    same_p = cells.groupBy("p").applyInPandas(_block_inversions(["ref", "est"], ["q"]), "inv long")
    # every cell of the block table meets the points in earlier p-blocks and later q-blocks
    cells = cells.groupBy("p", "q").agg(F.sum("w").cast("decimal(38,0)").alias("w"))
    n_cells = F.lit(blocks).cast("long")
    grid = spark.range(blocks * blocks).select(
        F.floor(F.col("id") / n_cells).cast("int").alias("p"), F.pmod(F.col("id"), n_cells).cast("int").alias("q")
    )
    grid = grid.join(cells, ["p", "q"], "left").select("p", "q", F.coalesce("w", F.lit(0).cast("decimal(38,0)")).alias("w"))
    later = Window.partitionBy("p").orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("q").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("right", F.sum("w").over(later)).withColumn("above", F.sum("right").over(earlier))
    between = grid.filter("w > 0 AND above > 0").select((F.col("w") * F.col("above")).cast("decimal(38,0)").alias("inv"))
    inside = same_q.unionAll(same_p).select(F.col("inv").cast("decimal(38,0)").alias("inv"))
    discordant = inside.unionAll(between).agg(F.sum("inv").cast("double").alias("discordant"))

    n = F.col("n").cast("decimal(19,0)")
    pairs_of_n = F.floor(n * (n - 1) / 2).cast("decimal(38,0)")

    def tied(cols: list[str], name: str) -> DataFrame:
        return points.groupBy(*cols).agg(F.sum("w").alias("n")).agg(F.sum(pairs_of_n).alias(name))

    everything = points.agg(F.sum("w").alias("n")).select(pairs_of_n.alias("all_pairs"))
    counts = one_row(
        discordant, tied(["ref"], "tied_ref"), tied(["est"], "tied_est"), tied(["ref", "est"], "tied_both"), everything
    )
    usable = (F.col("all_pairs") - F.col("tied_ref") - F.col("tied_est") + F.col("tied_both")).cast("double")
    scale = F.sqrt((F.col("all_pairs") - F.col("tied_ref")).cast("double")) * F.sqrt(
        (F.col("all_pairs") - F.col("tied_est")).cast("double")
    )
    return counts.select(F.try_divide(usable - 2 * F.col("discordant"), scale).alias("tau"))


def evaluation_report(
    pred: DataFrame, task_params: DataFrame | None = None, worker_params: DataFrame | None = None
) -> DataFrame:
    """One row with every label metric and, when given, parameter correlations."""
    parts = [class_scores(pred), auc(pred)]
    missing = []
    for side, pairs in (("task", task_params), ("worker", worker_params)):
        if pairs is None:
            missing += [f"{side}_tau", f"{side}_rho"]
            continue
        parts.append(kendall_tau(pairs).withColumnRenamed("tau", f"{side}_tau"))
        parts.append(pearson(pairs).withColumnRenamed("rho", f"{side}_rho"))
    out = one_row(*parts)
    for name in missing:
        out = out.withColumn(name, F.lit(None).cast("double"))
    return out.select(
        "tn", "fp", "fn", "tp", "acc", "auc", "posi_p", "posi_r", "posi_f1",
        "nega_p", "nega_r", "nega_f1", "task_tau", "task_rho", "worker_tau", "worker_rho",
    )
