"""Variational feature prior on two weights, where every step has a closed form that SQL can unroll."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions.vectorx import gauss_hermite
from tallyfold.models.probit import feature_map
from tallyfold.models.variational import variational_prior
from tallyfold.models.workers import OneCoinWorker
from tallyfold.plans.em_sql import _labels, _posterior, labels_sql
from tallyfold.plans.fragments import V2, cdf, pdf
from tallyfold.plans.prior_models import X_SQL, linear_inputs
from tallyfold.plans.registry import query

ROUNDS = 2
RATE = 0.5


def num(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


GH = " UNION ALL ".join(f"SELECT {num(x)} AS t, {num(w)} AS w" for x, w in zip(*gauss_hermite(20)))


def variational_ctes(rounds: int, feature: str, turned: str | None, learn: bool) -> str:
    """q{t}(m1, m2, s11, s12, s22, v, l), one-coin workers c{t} and posteriors e{t}.

    ``feature`` is the second feature as SQL over x, v (variance) and l (lengthscale); ``turned`` is its derivative in
    the logarithm of l (None without a lengthscale).
    """
    ctes = [
        f"ks AS ({_labels(2)})",
        f"ann AS MATERIALIZED (SELECT task_id, worker_id, max(label) AS label FROM ({V2}) AS src GROUP BY 1, 2)",
        f"feat AS MATERIALIZED ({X_SQL})",
        f"gh AS MATERIALIZED ({GH})",
        "c0 AS MATERIALIZED (SELECT worker_id, 0.7e0 AS c FROM (SELECT DISTINCT worker_id FROM ann) w)",
        "q0 AS (SELECT 0e0 AS m1, 0e0 AS m2, 1e0 AS s11, 0e0 AS s12, 1e0 AS s22, 1e0 AS v, 1e0 AS l)",
    ]
    for t in range(1, rounds + 2):
        b = f"q{t - 1}"
        ctes += [
            f"""f{t} AS MATERIALIZED (SELECT *, m1 + m2 * y AS fm, greatest(s11 + 2 * s12 * y + s22 * y * y, 0e0) AS fv
              FROM (SELECT *, {feature} AS y FROM feat, {b}) AS z)""",
            f"""n{t} AS (SELECT task_id, w, f, {cdf('f')} * (1e0 - 2e-6) + 1e-6 AS p, {pdf('f')} * (1e0 - 2e-6) AS s
              FROM (SELECT task_id, w, fm + sqrt(fv) * t AS f FROM f{t}, gh) AS z)""",
            f"""x{t} AS MATERIALIZED (SELECT task_id, sum(w * ln(p)) AS lp1, sum(w * ln(1e0 - p)) AS lp0, sum(w * s / p) AS d1,
              -sum(w * s / (1e0 - p)) AS d0, sum(w * (-f * s / p - s * s / (p * p))) AS c1,
              sum(w * (f * s / (1e0 - p) - s * s / ((1e0 - p) * (1e0 - p)))) AS c0 FROM n{t} GROUP BY task_id)""",
            f"""k{t} AS (SELECT a.task_id, ks.v AS z, CASE WHEN a.label = ks.v THEN c.c ELSE 1e0 - c.c END AS p
              FROM ann a CROSS JOIN ks JOIN c{t - 1} c ON c.worker_id = a.worker_id)""",
            f"""h{t} AS (SELECT * FROM k{t} UNION ALL SELECT task_id, ks.v AS z, CASE WHEN ks.v = 1 THEN exp(lp1) ELSE exp(lp0) END AS p
              FROM x{t} CROSS JOIN ks WHERE task_id IN (SELECT task_id FROM ann))""",
            *_posterior(f"e{t}", f"h{t}", 2, "SELECT v AS z, 1e0 AS p FROM ks"),
        ]
        if t > rounds:
            break
        ctes += [
            f"c{t} AS MATERIALIZED (SELECT a.worker_id, avg(e.g) AS c FROM ann a JOIN e{t} e ON e.task_id = a.task_id AND e.z = a.label GROUP BY 1)",
            f"""g{t} AS MATERIALIZED (SELECT f.*, e.g * x.d1 + (1e0 - e.g) * x.d0 AS d, greatest(-(e.g * x.c1 + (1e0 - e.g) * x.c0), 0e0) AS c
              FROM f{t} f JOIN x{t} x ON x.task_id = f.task_id JOIN e{t} e ON e.task_id = f.task_id AND e.z = 1)""",
        ]
        if learn:
            change = "greatest(least({r}e0 * ({d} - {p}) / n, 0.5e0), -0.5e0)"
            ctes.append(
                f"""t{t} AS MATERIALIZED (SELECT exp(ln(v) + {change.format(r=RATE, d='dv', p='v')}) AS v,
                  {f"exp(ln(l) + {change.format(r=RATE, d='dl', p='l')})" if turned else "l"} AS l FROM (
                  SELECT any_value(v) AS v, any_value(l) AS l, count(*) AS n, sum(a * 0.5e0 * y) AS dv, sum(a * {turned or '0e0'}) AS dl
                  FROM (SELECT *, d * m2 - c * (s12 + s22 * y) AS a FROM g{t}) AS z) AS z)"""
            )
        else:
            ctes.append(f"t{t} AS (SELECT v, l FROM {b})")
        ctes.append(
            f"""q{t} AS MATERIALIZED (SELECT (r1 * a22 - r2 * a12) / det AS m1, (r2 * a11 - r1 * a12) / det AS m2,
              a22 / det AS s11, -a12 / det AS s12, a11 / det AS s22, v, l FROM (
              SELECT *, a11 * a22 - a12 * a12 AS det FROM (
                SELECT any_value(v) AS v, any_value(l) AS l, 1e0 + sum(c) AS a11, sum(c * y) AS a12, 1e0 + sum(c * y * y) AS a22, sum(r) AS r1, sum(r * y) AS r2
                FROM (SELECT task_id, c, d + c * fm AS r, v, l, {feature} AS y FROM (SELECT g.task_id, g.x, g.c, g.d, g.fm, t.v, t.l FROM g{t} g, t{t} t) AS z) AS z) AS z) AS z)"""
        )
    return ",\n".join(ctes)


def _rbf_parts() -> tuple[str, str]:
    """Feature and its derivative in ln(lengthscale) for the one random Fourier feature of seed 0."""
    fmap = feature_map(None, {"rbf": [0]}, fourier=1, lengthscales=[1.0])
    turn = f"({num(fmap.frequencies[0, 0])} * x / l)"
    angle = f"({turn} + {num(fmap.phases[0])})"
    return f"(sqrt(2e0 * v) * cos({angle}))", f"(sqrt(2e0 * v) * sin({angle}) * {turn})"


LINEAR = variational_ctes(ROUNDS, "(sqrt(v) * x)", None, learn=False)
LINEAR_LEARNED = variational_ctes(ROUNDS, "(sqrt(v) * x)", None, learn=True)
RBF_LEARNED = variational_ctes(ROUNDS, *_rbf_parts(), learn=True)


def _fit(spark, d, rbf: bool, learn: bool):
    ann, features, dims = linear_inputs(spark, d)
    return variational_prior(
        ann, features, {"rbf": [0]} if rbf else dims, OneCoinWorker(init_competence=0.7), rounds=ROUNDS, threshold=None,
        learn_kernel=learn, kernel_rate=RATE, search=False, fourier=1, lengthscales=[1.0],
    )


def _labels_of(fit):
    return fit.labels.select("task_id", "label", F.round("score", 6).alias("score"))


def _parameters(spark, fit, names: list[str]):
    from tallyfold.models.variational import kernel_values

    m, s = fit.weights, fit.covariance
    values = [m[0], m[1], s[0, 0], s[0, 1], s[1, 1], *kernel_values(fit.feature_map)]
    return spark.range(1).select(*[F.round(F.lit(float(v)), 5).alias(n) for n, v in zip(names, values)])


Q_NAMES = ["m1", "m2", "s11", "s12", "s22"]


def _q_sql(names: list[str]) -> str:
    return f"SELECT {', '.join(f'round({n}, 5) AS {n}' for n in names)} FROM q{ROUNDS}"


@query("g33_variational_linear", f"WITH {LINEAR} {labels_sql(f'e{ROUNDS + 1}')}")
def g33(spark, d):
    return _labels_of(_fit(spark, d, rbf=False, learn=False))


@query("g33_variational_weights", f"WITH {LINEAR} {_q_sql(Q_NAMES)}")
def g33_weights(spark, d):
    return _parameters(spark, _fit(spark, d, rbf=False, learn=False), Q_NAMES)


@query("g28_learned_linear_variance", f"WITH {LINEAR_LEARNED} {_q_sql([*Q_NAMES, 'v'])}")
def g28_linear(spark, d):
    return _parameters(spark, _fit(spark, d, rbf=False, learn=True), [*Q_NAMES, "v"])


@query("g28_learned_lengthscale", f"WITH {RBF_LEARNED} {_q_sql([*Q_NAMES, 'v', 'l'])}")
def g28_rbf(spark, d):
    return _parameters(spark, _fit(spark, d, rbf=True, learn=True), [*Q_NAMES, "v", "l"])


@query("g19_learned_kernel_labels", f"WITH {RBF_LEARNED} {labels_sql(f'e{ROUNDS + 1}')}")
def g19(spark, d):
    return _labels_of(_fit(spark, d, rbf=True, learn=True))


@query(
    "g33_variational_bound",
    f"""WITH {LINEAR} SELECT t AS iter, round(bound, 3) AS bound FROM ({' UNION ALL '.join(
        f"SELECT {t} AS t, (SELECT sum(ev) FROM e{t + 1} WHERE z = 0)"
        " - 0.5e0 * (s11 + s22 + m1 * m1 + m2 * m2 - 2 - ln(s11 * s22 - s12 * s12)) - v AS bound FROM q" + str(t)
        for t in range(ROUNDS + 1))}) AS b""",
)
def g33_bound(spark, d):
    fit = _fit(spark, d, rbf=False, learn=False)
    return fit.trace.filter("metric = 'evidence_bound'").select("iter", F.round("value", 3).alias("bound"))
