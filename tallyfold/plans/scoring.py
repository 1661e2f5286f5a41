"""Label metrics and parameter recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.models.majority import majority_vote
from tallyfold.operators import annotations as A
from tallyfold.operators import evaluation as E
from tallyfold.operators import profile as P
from tallyfold.plans import views as V
from tallyfold.plans.fragments import PRED, V2
from tallyfold.plans.registry import query

AUC_SQL = """(SELECT round((sum(pos * (below + neg / 2e0))) / (sum(pos) * sum(neg)), 6) FROM (
  SELECT score, sum(gold) AS pos, sum(1 - gold) AS neg,
    coalesce(sum(sum(1 - gold)) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM pred GROUP BY score) s)"""
CELLS = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
CELL_SQL = ", ".join(
    f"CAST(sum(CASE WHEN gold = {g} AND pred = {p} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, (g, p) in CELLS.items()
)
SCORE_SQL = """round((tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), 6) AS acc,
  round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS posi_p,
  round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS posi_r,
  round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS posi_f1,
  round(coalesce(tn / CAST(nullif(tn + fn, 0) AS DOUBLE), 0), 6) AS nega_p,
  round(coalesce(tn / CAST(nullif(tn + fp, 0) AS DOUBLE), 0), 6) AS nega_r,
  round(coalesce(2 * tn / CAST(nullif(2 * tn + fp + fn, 0) AS DOUBLE), 0), 6) AS nega_f1"""
SCORE_COLS = ("acc", "posi_p", "posi_r", "posi_f1", "nega_p", "nega_r", "nega_f1")

# Two parameter tables over the same tasks and workers: true and estimated from majority labels.
TRUE_SKILL = f"SELECT worker_id, avg(CASE WHEN gold = label THEN 1e0 ELSE 0e0 END) AS ref FROM ({V2}) AS v GROUP BY 1"
EST_SKILL = f"""SELECT v.worker_id, avg(CASE WHEN p.pred = v.label THEN 1e0 ELSE 0e0 END) AS est
  FROM ({V2}) AS v JOIN pred p ON p.task_id = v.task_id GROUP BY 1"""
TRUE_DIFF = f"SELECT task_id, 1 - avg(CASE WHEN gold = label THEN 1e0 ELSE 0e0 END) AS ref FROM ({V2}) AS v GROUP BY 1"
EST_DIFF = "SELECT task_id, least(score, 1 - score) AS est FROM pred"
PARAM_CTES = f"""pred AS MATERIALIZED ({PRED}),
  wpair AS MATERIALIZED (SELECT a.worker_id, ref, est FROM ({TRUE_SKILL}) a JOIN ({EST_SKILL}) b ON b.worker_id = a.worker_id),
  tpair AS MATERIALIZED (SELECT a.task_id, ref, est FROM ({TRUE_DIFF}) a JOIN ({EST_DIFF}) b ON b.task_id = a.task_id)"""


def tau_sql(pairs: str) -> str:
    """Tau-b by comparing all pairs (small side only: one row per task or worker)."""
    return f"""(SELECT round(sum(sign(a.ref - b.ref) * sign(a.est - b.est)) /
      (sqrt(CAST(sum(CASE WHEN a.ref <> b.ref THEN 1 ELSE 0 END) AS DOUBLE)) *
       sqrt(CAST(sum(CASE WHEN a.est <> b.est THEN 1 ELSE 0 END) AS DOUBLE))), 6) FROM {pairs} a, {pairs} b)"""


def worker_pairs(spark, d):
    v2 = V.item_annotations(spark, d)
    truth = P.worker_competence(v2).withColumnRenamed("worker_competence", "ref")
    pred = V.vote_predictions(spark, d).select("task_id", F.col("pred").alias("gold"))
    est = P.worker_competence(v2.drop("gold").join(pred, "task_id")).withColumnRenamed("worker_competence", "est")
    return truth.join(est, "worker_id")


def task_pairs(spark, d):
    truth = P.task_difficulty(V.item_annotations(spark, d)).withColumnRenamed("task_difficulty", "ref")
    est = V.vote_predictions(spark, d).select("task_id", F.least(F.col("score"), 1 - F.col("score")).alias("est"))
    return truth.join(est, "task_id")


@query("h01_confusion", f"WITH pred AS ({PRED}) SELECT {CELL_SQL} FROM pred")
def h01(spark, d):
    return E.confusion(V.vote_predictions(spark, d))


@query("h02_accuracy", f"WITH pred AS ({PRED}) SELECT avg(CASE WHEN gold = pred THEN 1e0 ELSE 0e0 END) AS acc FROM pred")
def h02(spark, d):
    return E.accuracy(V.vote_predictions(spark, d))


@query(
    "h03_precision_recall_f1",
    f"WITH pred AS ({PRED}), c AS (SELECT {CELL_SQL} FROM pred) SELECT {SCORE_SQL} FROM c",
)
def h03(spark, d):
    return E.class_scores(V.vote_predictions(spark, d)).select(*[F.round(c, 6).alias(c) for c in SCORE_COLS])


@query("h04_auc", f"WITH pred AS ({PRED}) SELECT {AUC_SQL} AS auc")
def h04(spark, d):
    return E.auc(V.vote_predictions(spark, d)).select(F.round("auc", 6).alias("auc"))


@query(
    "h05_rank_correlation",
    f"""WITH {PARAM_CTES} SELECT 'task' AS side, {tau_sql('tpair')} AS tau, (SELECT round(corr(ref, est), 6) FROM tpair) AS rho
      UNION ALL SELECT 'worker' AS side, {tau_sql('wpair')} AS tau, (SELECT round(corr(ref, est), 6) FROM wpair) AS rho""",
)
def h05(spark, d):
    rows = None
    for side, pairs in (("task", task_pairs(spark, d)), ("worker", worker_pairs(spark, d))):
        both = P.one_row(E.kendall_tau(pairs), E.pearson(pairs))
        row = both.select(F.lit(side).alias("side"), F.round("tau", 6).alias("tau"), F.round("rho", 6).alias("rho"))
        rows = row if rows is None else rows.unionAll(row)
    return rows


@query(
    "h05_rank_correlation_blocks",
    f"WITH {PARAM_CTES} SELECT {tau_sql('tpair')} AS tau",
)
def h05b(spark, d):
    return E.kendall_tau(task_pairs(spark, d), blocks=7).select(F.round("tau", 6).alias("tau"))


@query(
    "h06_parameter_error",
    f"WITH {PARAM_CTES} SELECT round(avg((ref - est) * (ref - est)), 8) AS mse FROM wpair",
)
def h06(spark, d):
    return E.mean_squared_error(worker_pairs(spark, d)).select(F.round("mse", 8).alias("mse"))


REPORT_SQL = f"""WITH {PARAM_CTES}, c AS (SELECT {CELL_SQL} FROM pred)
SELECT tn, fp, fn, tp, {SCORE_SQL}, {AUC_SQL} AS auc, {tau_sql('tpair')} AS task_tau,
  (SELECT round(corr(ref, est), 6) FROM tpair) AS task_rho, {tau_sql('wpair')} AS worker_tau,
  (SELECT round(corr(ref, est), 6) FROM wpair) AS worker_rho FROM c"""


def rounded_report(report):
    counts = ["tn", "fp", "fn", "tp"]
    return report.select(*counts, *[F.round(c, 6).alias(c) for c in report.columns if c not in (*counts, "model")])


@query("h07_evaluation_report", REPORT_SQL)
def h07(spark, d):
    return rounded_report(
        E.evaluation_report(V.vote_predictions(spark, d), task_pairs(spark, d), worker_pairs(spark, d))
    )


def majority_on_topics(spark, d):
    v1 = V.topic_tasks(spark, d)
    votes = majority_vote(A.canonical(v1, "max"))
    return votes.join(A.gold_labels(v1), "task_id").select("task_id", "gold", F.col("label").alias("pred"), "score")
