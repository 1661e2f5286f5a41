"""Expectation propagation of the Gaussian-probit model, unrolled in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.models.propagation import gaussian_noise_moments, noise_prior_moments
from tallyfold.plans import views as V
from tallyfold.plans.fragments import V2, cdf, pdf
from tallyfold.plans.prior_models import X_SQL, linear_inputs
from tallyfold.plans.registry import query

SWEEPS = 2
NOISE = 0.1
DAMPING = 0.5


def propagation_ctes(sweeps: int, features: bool) -> str:
    """Site sums t{n} and w{n} after n sweeps; with ``features`` also weights k{n}(a, b, c11, c12, c22)."""
    ctes = [
        f"ann AS MATERIALIZED (SELECT task_id, worker_id, CASE WHEN max(label) = 1 THEN 1e0 ELSE -1e0 END AS sign FROM ({V2}) AS src GROUP BY 1, 2)",
        "s0 AS (SELECT *, 0e0 AS tt, 0e0 AS tn, 0e0 AS wt, 0e0 AS wn FROM ann)",
        f"feat AS MATERIALIZED ({X_SQL})",
        "k0 AS (SELECT 0e0 AS a, 0e0 AS b, 1e0 AS c11, 0e0 AS c12, 1e0 AS c22)",
    ]
    for n in range(sweeps + 1):
        ctes.append(f"t{n} AS MATERIALIZED (SELECT task_id, sum(tt) AS tau, sum(tn) AS nu FROM s{n} GROUP BY 1)")
        ctes.append(f"w{n} AS MATERIALIZED (SELECT worker_id, sum(wt) AS tau, sum(wn) AS nu FROM s{n} GROUP BY 1)")
        if features and n:
            ctes.append(
                f"""k{n} AS MATERIALIZED (SELECT (r1 * g22 - r2 * g12) / det AS a, (r2 * g11 - r1 * g12) / det AS b, g22 / det AS c11, -g12 / det AS c12,
                  g11 / det AS c22 FROM (SELECT *, g11 * g22 - g12 * g12 AS det FROM (SELECT 1e0 + sum(l) AS g11, sum(l * x) AS g12, 1e0 + sum(l * x * x) AS g22,
                  sum(y) AS r1, sum(y * x) AS r2 FROM (SELECT x, tau / (1e0 + tau) AS l, nu / (1e0 + tau) AS y FROM t{n} JOIN feat USING (task_id)) AS z) AS z) AS z)"""
            )
        if n == sweeps:
            break
        if features:
            ctes.append(
                f"""c{n} AS (SELECT task_id, h / p AS m, 1e0 / p AS v FROM (SELECT task_id, 1e0 / fv - tau / (1e0 + tau) AS p, fm / fv - nu / (1e0 + tau) AS h
                  FROM (SELECT f.task_id, a + b * x AS fm, c11 + 2 * c12 * x + c22 * x * x AS fv, tau, nu FROM feat f JOIN t{n} t ON t.task_id = f.task_id, k{n}) AS z) AS z)"""
            )
            side = f"(SELECT t.task_id, 1e0 / (1e0 + v) + tau AS tp, m / (1e0 + v) + nu AS th FROM t{n} t JOIN c{n} c ON c.task_id = t.task_id)"
        else:
            side = f"(SELECT task_id, 0.5e0 + tau AS tp, nu AS th FROM t{n})"
        ctes += [
            f"""v{n} AS (SELECT s.*, 1e0 / (tp - tt) AS vt, (th - tn) / (tp - tt) AS mt, 1e0 / (1e0 + w.tau - wt) AS vw, (w.nu - wn) / (1e0 + w.tau - wt) AS mw
              FROM s{n} s JOIN {side} t ON t.task_id = s.task_id JOIN w{n} w ON w.worker_id = s.worker_id)""",
            f"z{n} AS (SELECT *, sign * (mt + mw) / c AS z FROM (SELECT *, sqrt({1 + 2 * NOISE!r}e0 + vt + vw) AS c FROM v{n}) AS y)",
            f"r{n} AS (SELECT *, {pdf('z')} * (1e0 - 2e-6) / ({cdf('z')} * (1e0 - 2e-6) + 1e-6) AS r FROM z{n})",
            f"q{n} AS (SELECT *, greatest(least(r * (r + z), 1e0), 0e0) / (c * c) AS k, sign * r / c AS pull FROM r{n})",
            f"""s{n + 1} AS MATERIALIZED (SELECT task_id, worker_id, sign, {1 - DAMPING}e0 * tt + {DAMPING}e0 * k / (1e0 - k * vt) AS tt,
              {1 - DAMPING}e0 * tn + {DAMPING}e0 * (pull + mt * k) / (1e0 - k * vt) AS tn, {1 - DAMPING}e0 * wt + {DAMPING}e0 * k / (1e0 - k * vw) AS wt,
              {1 - DAMPING}e0 * wn + {DAMPING}e0 * (pull + mw * k) / (1e0 - k * vw) AS wn FROM q{n})""",
        ]
    return ",\n".join(ctes)


PLAIN, WITH_FEATURES = propagation_ctes(SWEEPS, False), propagation_ctes(SWEEPS, True)
HOW = {"noise": NOISE, "sweeps": SWEEPS, "tolerance": 0.0, "damping": DAMPING}


@query(
    "g25_noise_moments",
    f"""WITH {PLAIN}, f AS (SELECT task_id, 0.5e0 * nu / (0.5e0 + tau) AS m, 0.5e0 + 0.25e0 / (0.5e0 + tau) AS v FROM t{SWEEPS})
    SELECT task_id, CASE WHEN m >= 0 THEN 1 ELSE 0 END AS label, round({cdf('m / sqrt(v)')}, 6) AS score, round(m, 6) AS f_mean, round(v, 6) AS f_var FROM f""",
)
def g25(spark, d):
    fit = gaussian_noise_moments(V.item_annotations(spark, d), **HOW)
    both = fit.labels.join(fit.tasks, "task_id")
    return both.select("task_id", "label", *[F.round(c, 6).alias(c) for c in ("score", "f_mean", "f_var")])


WORKERS = f"SELECT worker_id, round(nu / (1e0 + tau), 6) AS worker_mean, round(1e0 / (1e0 + tau), 6) AS worker_var FROM w{SWEEPS}"


def _workers(fit):
    return fit.workers.select("worker_id", F.round("worker_mean", 6).alias("worker_mean"), F.round("worker_var", 6).alias("worker_var"))


@query("g25_noise_moments_workers", f"WITH {PLAIN} {WORKERS}")
def g25_workers(spark, d):
    return _workers(gaussian_noise_moments(V.item_annotations(spark, d), **HOW))


@query("g24_noise_prior_moments_workers", f"WITH {WITH_FEATURES} {WORKERS}")
def g24_workers(spark, d):
    return _workers(noise_prior_moments(*linear_inputs(spark, d), **HOW))


@query(
    "g24_noise_prior_moments",
    f"""WITH {WITH_FEATURES}, f AS (SELECT task_id, a + b * x AS m, c11 + 2 * c12 * x + c22 * x * x AS v FROM feat, k{SWEEPS}),
      p AS (SELECT task_id, {cdf('m / sqrt(1e0 + v)')} AS p FROM f)
    SELECT task_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS label, round(p, 5) AS mean FROM p""",
)
def g24(spark, d):
    fit = noise_prior_moments(*linear_inputs(spark, d), **HOW)
    return fit.predictions.select("task_id", "label", F.round("mean", 5).alias("mean"))
