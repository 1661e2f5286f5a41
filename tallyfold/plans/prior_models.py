"""Feature-prior models on one linear feature, where the Newton step has a closed form that SQL can unroll."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.models.probit import feature_map, feature_prior, mapped, prior_on_votes
from tallyfold.models.workers import ConfusionWorker, OneCoinWorker, SpammerWorker, dawid_skene, mace
from tallyfold.operators import annotations as A
from tallyfold.plans import views as V
from tallyfold.plans.em_sql import _labels, _posterior, digamma_sql, ds_ctes, labels_sql, mace_variational_ctes
from tallyfold.plans.fragments import V2, cdf, link, pdf
from tallyfold.plans.registry import query

ROUNDS = 2
DIMS = {"linear": [0]}
# One feature per part that agrees with its gold label more often than not.
X_SQL = """SELECT p_partkey AS task_id, CAST(p_partkey * 37 % 101 AS DOUBLE) / 101e0 - 0.5e0
  + CASE WHEN p_size % 2 = 1 THEN 0.4e0 ELSE -0.4e0 END AS x FROM part"""
JITTER = "1e-6"


def linear_inputs(spark, d):
    parts = V.table(spark, d, "part")
    x = (F.col("p_partkey") * 37 % 101).cast("double") / 101.0 - 0.5 + F.when(F.col("p_size") % 2 == 1, 0.4).otherwise(-0.4)
    features = parts.select(F.col("p_partkey").alias("task_id"), F.array(x).alias("features"))
    return V.item_annotations(spark, d), features, DIMS


def _newton(name: str, targets: str, before: str) -> list[str]:
    """One Fisher-scoring step of the probit weights (a, b) for ``targets(x, y)``."""
    p = f"({cdf('f')} * (1e0 - 2 * {JITTER}) + {JITTER})"
    s = f"({pdf('f')} * (1e0 - 2 * {JITTER}))"
    return [
        f"""{name}_t AS (SELECT x, {s} * (y / {p} - (1e0 - y) / (1e0 - {p})) AS g, {s} * {s} / ({p} * (1e0 - {p})) AS v
          FROM (SELECT t.x, t.y, w.a + w.b * t.x AS f FROM ({targets}) t, {before} w) AS z)""",
        f"""{name} AS MATERIALIZED (SELECT a + (g22 * r1 - g12 * r2) / (g11 * g22 - g12 * g12) AS a,
          b + (g11 * r2 - g12 * r1) / (g11 * g22 - g12 * g12) AS b,
          g22 / (g11 * g22 - g12 * g12) AS c11, -g12 / (g11 * g22 - g12 * g12) AS c12, g11 / (g11 * g22 - g12 * g12) AS c22
          FROM (SELECT w.a, w.b, 1e0 + sum(v) AS g11, sum(v * x) AS g12, 1e0 + sum(v * x * x) AS g22,
            sum(g) - w.a AS r1, sum(g * x) - w.b AS r2 FROM {name}_t, {before} w GROUP BY w.a, w.b) AS z)""",
    ]


def _likelihood(model: str, t: int) -> str:
    params = {
        "zc": (f"JOIN c{t} c ON c.worker_id = a.worker_id", "CASE WHEN a.label = ks.v THEN c.c ELSE 1e0 - c.c END"),
        "ds": (f"JOIN c{t} c ON c.worker_id = a.worker_id AND c.y = a.label AND c.z = ks.v", "c.p"),
        "mace": (
            f"JOIN c{t} c ON c.worker_id = a.worker_id AND c.y = a.label",
            "CASE WHEN a.label = ks.v THEN 1e0 - c.s ELSE 0e0 END + c.s * c.x",
        ),
    }
    join, p = params[model]
    return f"SELECT a.task_id, ks.v AS z, {p} AS p FROM ann a CROSS JOIN ks {join}"


def _start(model: str) -> str:
    workers = "(SELECT DISTINCT worker_id FROM ann) w"
    return {
        "zc": f"SELECT worker_id, 0.7e0 AS c FROM {workers}",
        "ds": f"""SELECT worker_id, z.v AS z, y.v AS y, CASE WHEN z.v = y.v THEN 0.7e0 ELSE {(1 - 0.7) / 1!r}e0 END AS p
          FROM {workers}, ks z, ks y""",
        "mace": f"SELECT worker_id, ks.v AS y, 0.5e0 AS s, 0.5e0 AS x FROM {workers}, ks",
    }[model]


def _update(model: str, t: int) -> str:
    post = f"e{t}"
    return {
        "zc": f"""SELECT a.worker_id, avg(e.g) AS c FROM ann a JOIN {post} e ON e.task_id = a.task_id AND e.z = a.label GROUP BY 1""",
        "ds": f"""SELECT worker_id, z, y, hit / mass AS p FROM (
          SELECT a.worker_id, e.z, y.v AS y, sum(e.g) AS mass, sum(CASE WHEN a.label = y.v THEN e.g ELSE 0e0 END) AS hit
          FROM ann a JOIN {post} e ON e.task_id = a.task_id CROSS JOIN ks y GROUP BY 1, 2, 3) AS q""",
        "mace": f"""SELECT worker_id, ks.v AS y, (sum(spam) + 0.5e0) / (count(*) + 1e0) AS s,
          (sum(CASE WHEN label = ks.v THEN spam ELSE 0e0 END) + 0.01e0) / (sum(spam) + 0.02e0) AS x FROM (
            SELECT a.worker_id, a.label, e.g * (c.s * c.x / (1e0 - c.s + c.s * c.x)) + (1e0 - e.g) AS spam
            FROM ann a JOIN c{t - 1} c ON c.worker_id = a.worker_id AND c.y = a.label
            JOIN {post} e ON e.task_id = a.task_id AND e.z = a.label) AS m CROSS JOIN ks GROUP BY 1, 2""",
    }[model]


def prior_ctes(model: str, rounds: int, steps: int = 2, freeze: str | None = None, first: int = 0) -> str:
    """Posteriors e1 .. e(rounds + 1), parameters c0 .. and weights w0 ..; ``freeze`` holds a block from
    round ``first`` + 1 on."""
    ctes = [
        f"ks AS ({_labels(2)})",
        f"ann AS MATERIALIZED (SELECT task_id, worker_id, max(label) AS label FROM ({V2}) AS src GROUP BY 1, 2)",
        f"feat AS MATERIALIZED ({X_SQL})",
        f"c0 AS MATERIALIZED ({_start(model)})",
        "w0 AS (SELECT 0e0 AS a, 0e0 AS b)",
    ]
    for t in range(1, rounds + 2):
        ctes.append(f"l{t} AS ({_likelihood(model, t - 1)})")
        ctes.append(
            f"""h{t} AS MATERIALIZED (SELECT task_id, ks.v AS z, CASE WHEN ks.v = 1 THEN p ELSE 1e0 - p END AS p FROM (
              SELECT f.task_id, {link('w.a + w.b * f.x')} AS p FROM feat f, w{t - 1} w) AS q CROSS JOIN ks)"""
        )
        # the prior is per task, so it enters as one more likelihood factor under a flat prior of ones
        ctes.append(f"m{t} AS (SELECT * FROM l{t} UNION ALL SELECT * FROM h{t} WHERE task_id IN (SELECT task_id FROM ann))")
        ctes += _posterior(f"e{t}", f"m{t}", 2, "SELECT v AS z, 1e0 AS p FROM ks")
        if t > rounds:
            break
        held = freeze if t > first else None
        ctes.append(f"c{t} AS MATERIALIZED ({f'SELECT * FROM c{t - 1}' if held == 'workers' else _update(model, t)})")
        before = f"w{t - 1}"
        targets = f"SELECT f.x, e.g AS y FROM e{t} e JOIN feat f ON f.task_id = e.task_id WHERE e.z = 1"
        for s in range(steps if held != "prior" else 0):
            ctes += _newton(f"w{t}_{s}", targets, before)
            before = f"w{t}_{s}"
        ctes.append(f"w{t} AS MATERIALIZED (SELECT a, b FROM {before})")
    return ",\n".join(ctes)


def _fit(spark, d, model, **kw):
    return feature_prior(*linear_inputs(spark, d), model, **{"rounds": ROUNDS, "threshold": None, **kw})


def _scored(fit):
    return fit.labels.select("task_id", "label", F.round("score", 6).alias("score"))


END = f"e{ROUNDS + 1}"


@query("g19_feature_prior_linear", f"WITH {prior_ctes('zc', ROUNDS)} {labels_sql(END)}")
def g19(spark, d):
    return _scored(_fit(spark, d, OneCoinWorker(init_competence=0.7)))


@query(
    "g21_prior_linear_workers",
    f"""WITH {prior_ctes('zc', ROUNDS)} SELECT worker_id, round(c, 6) AS competence,
      (SELECT round(a, 5) FROM w{ROUNDS}) AS bias, (SELECT round(b, 5) FROM w{ROUNDS}) AS slope FROM c{ROUNDS}""",
)
def g21(spark, d):
    fit = _fit(spark, d, OneCoinWorker(init_competence=0.7))
    return fit.workers.select(
        "worker_id", F.round("competence", 6).alias("competence"),
        F.round(F.lit(float(fit.weights[0])), 5).alias("bias"), F.round(F.lit(float(fit.weights[1])), 5).alias("slope"),
    )


@query("g22_prior_mace_linear", f"WITH {prior_ctes('mace', ROUNDS)} {labels_sql(END)}")
def g22(spark, d):
    return _scored(_fit(spark, d, SpammerWorker()))


@query("g23_prior_ds_linear", f"WITH {prior_ctes('ds', ROUNDS)} {labels_sql(END)}")
def g23(spark, d):
    return _scored(_fit(spark, d, ConfusionWorker()))


VOTES = f"""ks AS ({_labels(2)}), feat AS MATERIALIZED ({X_SQL}),
  votes AS MATERIALIZED (SELECT task_id, CASE WHEN 2 * sum(label) >= count(*) THEN 1e0 ELSE 0e0 END AS y FROM (
    SELECT task_id, worker_id, max(label) AS label FROM ({V2}) AS v GROUP BY 1, 2) AS u GROUP BY 1),
  w0 AS (SELECT 0e0 AS a, 0e0 AS b)"""


def _votes_sql(steps: int) -> str:
    targets = "SELECT f.x, v.y FROM votes v JOIN feat f ON f.task_id = v.task_id"
    ctes = [VOTES]
    for s in range(1, steps + 1):
        ctes += _newton(f"w{s}", targets, f"w{s - 1}")
    return ",\n".join(ctes)


@query(
    "g26_prior_on_votes_linear",
    f"""WITH {_votes_sql(3)}, f AS (SELECT task_id, a + b * x AS m, c11 + 2 * c12 * x + c22 * x * x AS v FROM feat, w3),
      p AS (SELECT task_id, {cdf('m / sqrt(1e0 + v)')} AS p FROM f)
    SELECT task_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS label, round(p, 5) AS mean, round(p - p * p, 5) AS var FROM p""",
)
def g26(spark, d):
    fit = prior_on_votes(*linear_inputs(spark, d), newton_steps=3)
    return fit.predictions.select("task_id", "label", F.round("mean", 5).alias("mean"), F.round("var", 5).alias("var"))


@query("g28_feature_map_linear", f"SELECT task_id, round(1e0, 6) AS bias, round(sqrt(1e0) * x, 6) AS phi1 FROM ({X_SQL}) AS f")
def g28(spark, d):
    _, features, dims = linear_inputs(spark, d)
    phi = mapped(features, feature_map(features, dims))
    return phi.select("task_id", F.round(F.col("phi")[0], 6).alias("bias"), F.round(F.col("phi")[1], 6).alias("phi1"))


@query(
    "g29_predict_new_linear",
    f"""WITH {_votes_sql(3)}, f AS (SELECT task_id, a + b * (0e0 - x) AS m, c11 - 2 * c12 * x + c22 * x * x AS v FROM feat, w3),
      p AS (SELECT task_id, {cdf('m / sqrt(1e0 + v)')} AS p FROM f)
    SELECT task_id, round(p, 5) AS mean FROM p""",
)
def g29(spark, d):
    ann, features, dims = linear_inputs(spark, d)
    fit = prior_on_votes(ann, features, dims, newton_steps=3)
    mirrored = features.select("task_id", F.transform("features", lambda v: -v).alias("features"))
    return fit.predict_new(mirrored).select("task_id", F.round("mean", 5).alias("mean"))


def _refit(spark, d, freeze):
    first = _fit(spark, d, OneCoinWorker(init_competence=0.7), rounds=1)
    return _fit(
        spark, d, OneCoinWorker(init_competence=0.7), rounds=1, freeze=freeze,
        start_params=first.params, start_weights=first.weights,
    )


@query(
    "g34_refit_prior_only",
    f"WITH {prior_ctes('zc', 2, freeze='workers', first=1)} SELECT round(a, 5) AS bias, round(b, 5) AS slope FROM w2",
)
def g34(spark, d):
    w = _refit(spark, d, "workers").weights
    return spark.range(1).select(F.round(F.lit(float(w[0])), 5).alias("bias"), F.round(F.lit(float(w[1])), 5).alias("slope"))


@query(
    "g34_refit_workers_only",
    f"WITH {prior_ctes('zc', 2, freeze='prior', first=1)} SELECT worker_id, round(c, 6) AS competence FROM c2",
)
def g34b(spark, d):
    return _refit(spark, d, "prior").workers.select("worker_id", F.round("competence", 6).alias("competence"))


@query(
    "g14_mace_variational_competence",
    f"WITH {mace_variational_ctes(V2, 2, 3)} SELECT worker_id, round(c / (s + c), 6) AS competence FROM s3",
)
def g14(spark, d):
    fit = mace(V.item_annotations(spark, d), rounds=3, variational=True)
    return fit.workers.select("worker_id", F.round("competence", 6).alias("competence"))


@query("g14_digamma", f"SELECT p_partkey, round({digamma_sql('p_retailprice / 100e0')}, 6) AS psi FROM part")
def g14_digamma(spark, d):
    from tallyfold.functions.mathx import digamma

    return V.table(spark, d, "part").select("p_partkey", F.round(digamma(F.col("p_retailprice").cast("double") / 100.0), 6).alias("psi"))


# ---- traces ----

TRACE_GOLD = f"SELECT task_id, max(gold) AS gold FROM ({V2}) AS v GROUP BY 1"


def _metrics_sql(t: int, error: str) -> str:
    """Metrics of the labels of ``e{t}`` and the squared error of a parameter, one row each."""
    cells = ", ".join(
        f"CAST(count(*) FILTER (gold = {g} AND label = {p}) AS DOUBLE) AS {name}" for name, g, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    )
    values = {
        **{c: c for c in ("tn", "fp", "fn", "tp")},
        "acc": "(tp + tn) / (tp + tn + fp + fn)",
        "posi_f1": "2 * tp / (2 * tp + fp + fn)",
        "nega_f1": "2 * tn / (2 * tn + fp + fn)",
    }
    counted = f"(SELECT {cells} FROM ({labels_sql(f'e{t}')}) AS l JOIN ({TRACE_GOLD}) AS g USING (task_id)) AS c"
    rows = [f"SELECT '{name}' AS metric, {value} AS value FROM {counted}" for name, value in values.items()]
    return f"SELECT CAST({t} AS INT) AS iter, metric, round(value, 6) AS value FROM ({' UNION ALL '.join([*rows, error])}) AS m"


def _trace_sql(ctes: str, error) -> str:
    return f"WITH {ctes} " + " UNION ALL ".join(_metrics_sql(t, error(t)) for t in range(1, ROUNDS + 1))


def _trace_rows(fit):
    """All but the evidence and AUC, whose ties depend on the last bit of a score."""
    rows = fit.trace.filter("metric NOT IN ('log_likelihood', 'evidence_bound', 'auc')")
    return rows.select("iter", "metric", F.round("value", 6).alias("value"))


@query(
    "a15_fit_trace_metrics",
    _trace_sql(
        ds_ctes(V2, 2, ROUNDS),
        lambda t: f"SELECT 'p_mse' AS metric, avg((p - r) * (p - r)) AS value FROM (SELECT p, CASE WHEN z = y THEN 0.7e0 ELSE 0.3e0 END AS r FROM p{t}) AS d",
    ),
)
def a15_metrics(spark, d):
    ann = V.item_annotations(spark, d)
    cells = spark.createDataFrame([(z, y, 0.7 if z == y else 0.3) for z in (0, 1) for y in (0, 1)], "truth int, label int, ref double")
    ref = ann.select("worker_id").distinct().withColumn("truth", F.explode(F.array(F.lit(0), F.lit(1)))).join(F.broadcast(cells), "truth")
    fit = dawid_skene(
        ann, rounds=ROUNDS, threshold=None, gold=A.gold_labels(ann), ref_params={"p": ref}, logging_freq=1
    )
    return _trace_rows(fit)


@query(
    "a15_feature_trace_metrics",
    _trace_sql(
        prior_ctes("zc", ROUNDS),
        lambda t: f"SELECT 'competence_mse' AS metric, avg((c - 0.75e0) * (c - 0.75e0)) AS value FROM c{t}",
    ),
)
def a15_features(spark, d):
    ann = V.item_annotations(spark, d)
    ref = ann.select("worker_id").distinct().withColumn("ref", F.lit(0.75))
    fit = _fit(spark, d, OneCoinWorker(init_competence=0.7), gold=A.gold_labels(ann), ref_params={"competence": ref}, logging_freq=1)
    return _trace_rows(fit)
