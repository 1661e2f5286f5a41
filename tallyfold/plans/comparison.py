"""All models that SQL can unroll, compared in one report."""

from __future__ import annotations

from tallyfold.models.compare import compare_models
from tallyfold.operators import annotations as A
from tallyfold.plans import propagation_models as P
from tallyfold.plans import variational_models as Q
from tallyfold.plans.em_sql import ds_ctes, glad_conjugate_ctes, labels_sql, mace_ctes, zc_ctes
from tallyfold.plans.fragments import V2, cdf
from tallyfold.plans.prior_models import _votes_sql, linear_inputs, prior_ctes
from tallyfold.plans.registry import query

ROUNDS = 2
FIXED = {"rounds": ROUNDS, "threshold": None}
OPTIONS = {
    "ds": FIXED,
    "zc": FIXED,
    "mace": {"rounds": ROUNDS, "variational": False},
    "glad": {"rounds": 1, "threshold": None, "inner_steps": 3, "step_size": 0.5, "solver": "conjugate"},
    "likelihood_moments": P.HOW,
    "gpzc": FIXED,
    "gpds": FIXED,
    "gpmace": FIXED,
    "gpmv": {"newton_steps": 3},
    "gpcrowd_moments": P.HOW,
    "gpzc_variational": {**FIXED, "learn_kernel": True, "kernel_rate": Q.RATE, "search": False},
}
LABELS = {
    "mv": f"""SELECT task_id, CASE WHEN 2 * sum(label) >= count(*) THEN 1 ELSE 0 END AS label FROM (
      SELECT task_id, worker_id, max(label) AS label FROM ({V2}) AS v GROUP BY 1, 2) AS u GROUP BY 1""",
    "ds": f"WITH {ds_ctes(V2, 2, ROUNDS)} {labels_sql(f'e{ROUNDS}')}",
    "zc": f"WITH {zc_ctes(V2, 2, ROUNDS)} {labels_sql(f'e{ROUNDS + 1}')}",
    "mace": f"WITH {mace_ctes(V2, 2, ROUNDS)} {labels_sql(f'e{ROUNDS}')}",
    "glad": f"WITH {glad_conjugate_ctes(V2, 2, 1, 3, 0.5)} {labels_sql('e2')}",
    "likelihood_moments": f"WITH {P.PLAIN} SELECT task_id, CASE WHEN nu >= 0 THEN 1 ELSE 0 END AS label FROM t{P.SWEEPS}",
    **{f"gp{m}": f"WITH {prior_ctes(m, ROUNDS)} {labels_sql(f'e{ROUNDS + 1}')}" for m in ("zc", "ds", "mace")},
    "gpmv": f"""WITH {_votes_sql(3)} SELECT task_id, CASE WHEN {cdf('(a + b * x) / sqrt(1e0 + c11 + 2 * c12 * x + c22 * x * x)')} >= 0.5 THEN 1 ELSE 0 END AS label
      FROM feat, w3""",
    "gpcrowd_moments": f"""WITH {P.WITH_FEATURES} SELECT task_id, CASE WHEN {cdf('(a + b * x) / sqrt(1e0 + c11 + 2 * c12 * x + c22 * x * x)')} >= 0.5
      THEN 1 ELSE 0 END AS label FROM feat, k{P.SWEEPS}""",
    "gpzc_variational": f"WITH {Q.LINEAR_LEARNED} {labels_sql(f'e{ROUNDS + 1}')}",
}
GOLD = f"SELECT task_id, max(gold) AS gold FROM ({V2}) AS v GROUP BY 1"
COUNTS = " UNION ALL ".join(
    f"""SELECT '{name}' AS model, count(*) FILTER (gold = 0 AND label = 0) AS tn, count(*) FILTER (gold = 0 AND label = 1) AS fp,
      count(*) FILTER (gold = 1 AND label = 0) AS fn, count(*) FILTER (gold = 1 AND label = 1) AS tp FROM ({sql}) AS l JOIN ({GOLD}) AS g USING (task_id)"""
    for name, sql in LABELS.items()
)


@query("h08_compare_all_models", f"SELECT model, tn, fp, fn, tp, round((tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS acc FROM ({COUNTS}) AS c")
def h08_all(spark, d):
    from pyspark.sql import functions as F

    ann, features, dims = linear_inputs(spark, d)
    report = compare_models(ann, A.gold_labels(ann), list(LABELS), features, dims, OPTIONS)
    return report.select("model", *[F.col(c).cast("long").alias(c) for c in ("tn", "fp", "fn", "tp")], F.round("acc", 6).alias("acc"))
