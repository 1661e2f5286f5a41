"""Label-aggregation models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfold.functions.mathx import probit_link, safe_ln
from tallyfold.functions.vectorx import gauss_hermite, gaussian_expectation
from tallyfold.models.compare import compare_models
from tallyfold.models.em import WorkerModel, fit_em
from tallyfold.models.glad import glad
from tallyfold.models.probit import (
    evidence_bound,
    feature_prior,
    log_marginal,
    mean_offset,
    predictive,
    prior_on_votes,
)
from tallyfold.models.sided import gaussian_noise, noise_prior, skill_prior
from tallyfold.models.supervised import classifier_labels
from tallyfold.models.workers import (
    ConfusionWorker,
    OneCoinWorker,
    SpammerWorker,
    dawid_skene,
    mace,
    one_coin,
    own_posterior,
)
from tallyfold.operators import annotations as A
from tallyfold.plans import views as V
from tallyfold.plans.em_sql import (
    ds_ctes,
    glad_conjugate_ctes,
    glad_ctes,
    labels_sql,
    likelihood_trace_sql,
    mace_ctes,
    mace_restart_ctes,
    shrunk_coin_ctes,
    zc_ctes,
)
from tallyfold.plans.fragments import T1, V2, V3, cdf, link
from tallyfold.plans.registry import query
from tallyfold.plans.tables import MV_SQL

ROUNDS = 3


def _labels(fit):
    return fit.labels.select("task_id", "label", F.round("score", 6).alias("score"))


def _ds(spark, d, k=2):
    return dawid_skene(V.item_annotations(spark, d, k), rounds=ROUNDS, threshold=None)


@query("g01_majority_vote", f"SELECT task_id, label FROM ({MV_SQL}) AS m")
def g01(spark, d):
    from tallyfold.models.compare import majority

    return majority(V.item_annotations(spark, d)).labels.select("task_id", "label")


@query(
    "g02_ds_start",
    f"WITH {ds_ctes(V2, 2, 1)} SELECT worker_id, CAST(z AS INT) AS truth, CAST(y AS INT) AS label, round(p, 6) AS p FROM p0",
)
def g02(spark, d):
    model = ConfusionWorker(2)
    workers = A.canonical(V.item_annotations(spark, d)).select("worker_id").distinct()
    params = workers.select("worker_id", *[c.alias(n) for n, c in model.init_columns().items()])
    return model.worker_table(params).withColumn("p", F.round("p", 6))


@query("g03_ds_posterior", f"WITH {ds_ctes(V2, 2, ROUNDS)} {labels_sql(f'e{ROUNDS}')}")
def g03(spark, d):
    return _labels(_ds(spark, d))


@query("g03_ds_posterior_topics", f"WITH {ds_ctes(T1, 2, ROUNDS)} {labels_sql(f'e{ROUNDS}')}")
def g03b(spark, d):
    return _labels(dawid_skene(V.topic_tasks(spark, d), rounds=ROUNDS, threshold=None))


@query(
    "g04_ds_parameters",
    f"WITH {ds_ctes(V2, 2, ROUNDS)} SELECT worker_id, CAST(z AS INT) AS truth, CAST(y AS INT) AS label, round(p, 6) AS p FROM p{ROUNDS}",
)
def g04(spark, d):
    return _ds(spark, d).workers.withColumn("p", F.round("p", 6))


@query(
    "g05_ds_likelihood",
    f"""WITH {ds_ctes(V2, 2, ROUNDS)},
      ll AS (SELECT a.task_id, p.z, sum(ln(p.p)) AS s FROM ann a JOIN p{ROUNDS} p ON p.worker_id = a.worker_id AND p.y = a.label WHERE p.p > 0 GROUP BY 1, 2)
    SELECT round((SELECT sum(ev) FROM e{ROUNDS + 1} WHERE z = 0), 4) AS log_likelihood,
      round((SELECT sum(CASE WHEN e.g > 0 THEN e.g * (ln(q.p) + ll.s) ELSE 0 END) FROM e{ROUNDS} e
        JOIN ll ON ll.task_id = e.task_id AND ll.z = e.z JOIN q{ROUNDS} q ON q.z = e.z), 4) AS q_value""",
)
def g05(spark, d):
    from tallyfold.models.quantities import q_function

    ann = V.item_annotations(spark, d)
    fit = dawid_skene(ann, rounds=ROUNDS, threshold=None)
    q = q_function(ann, fit, [0, 1])
    return q.select(
        F.round(F.lit(fit.trace_rows[-1][2]), 4).alias("log_likelihood"), F.round("q_value", 4).alias("q_value")
    )


@query(
    "g06_ds_run",
    f"WITH {ds_ctes(V3, 3, ROUNDS)} {labels_sql(f'e{ROUNDS}')}",
)
def g06(spark, d):
    return _labels(_ds(spark, d, 3))


@query(
    "g07_ds_parameters_k3",
    f"WITH {ds_ctes(V3, 3, ROUNDS)} SELECT worker_id, CAST(z AS INT) AS truth, CAST(y AS INT) AS label, round(p, 6) AS p FROM p{ROUNDS}",
)
def g07(spark, d):
    return _ds(spark, d, 3).workers.withColumn("p", F.round("p", 6))


@query("g08_zc_labels", f"WITH {zc_ctes(V2, 2, ROUNDS)} {labels_sql(f'e{ROUNDS + 1}')}")
def g08(spark, d):
    return _labels(one_coin(V.item_annotations(spark, d), rounds=ROUNDS, threshold=None))


@query(
    "g08_zc_competence_k3",
    f"WITH {zc_ctes(V3, 3, ROUNDS)} SELECT worker_id, round(c, 6) AS competence, "
    f"(SELECT round(sum(ev), 4) FROM e{ROUNDS + 2} WHERE z = 0) AS log_likelihood FROM c{ROUNDS + 1}",
)
def g08b(spark, d):
    fit = one_coin(V.item_annotations(spark, d, 3), rounds=ROUNDS, threshold=None)
    return fit.workers.select(
        "worker_id",
        F.round("competence", 6).alias("competence"),
        F.round(F.lit(fit.trace_rows[-1][2]), 4).alias("log_likelihood"),
    )


GLAD_SQL = glad_ctes(V2, 2, 1, 1, 0.5)


def _glad(spark, d, k=2):
    return glad(V.item_annotations(spark, d, k), rounds=1, threshold=None, inner_steps=1, step_size=0.5)


@query("g09_glad_labels", f"WITH {GLAD_SQL} {labels_sql('e2')}")
def g09(spark, d):
    return _labels(_glad(spark, d))


@query("g10_glad_easiness", f"WITH {GLAD_SQL} SELECT task_id, round(beta, 6) AS easiness FROM b_end")
def g10(spark, d):
    return _glad(spark, d).tasks.select("task_id", F.round("easiness", 6).alias("easiness"))


@query("g10_glad_line_search")
def g10b(spark, d):
    fit = glad(V.item_annotations(spark, d), rounds=2, threshold=0.0, inner_steps=2, solver="ascent")
    return fit.trace


CONJUGATE_SQL = glad_conjugate_ctes(V2, 2, 1, 3, 0.5)


def _conjugate(spark, d):
    return glad(V.item_annotations(spark, d), rounds=1, threshold=None, inner_steps=3, step_size=0.5, solver="conjugate")


@query("g10_glad_conjugate", f"WITH {CONJUGATE_SQL} SELECT worker_id, round(alpha, 6) AS competence FROM wa2")
def g10c(spark, d):
    return _conjugate(spark, d).workers.select("worker_id", F.round("competence", 6).alias("competence"))


@query("g10_glad_conjugate_easiness", f"WITH {CONJUGATE_SQL} SELECT task_id, round(beta, 6) AS easiness FROM wb2")
def g10d(spark, d):
    return _conjugate(spark, d).tasks.select("task_id", F.round("easiness", 6).alias("easiness"))


@query(
    "g10_glad_gradient_norm",
    f"WITH {CONJUGATE_SQL} SELECT 0 AS iter, round(g, 5) AS gradient_norm FROM top1 UNION ALL SELECT 1, round(g, 5) FROM top2",
)
def g10e(spark, d):
    trace = _conjugate(spark, d).trace.filter("metric = 'gradient_norm'")
    return trace.select("iter", F.round("value", 5).alias("gradient_norm"))


def _glad_objective(a: str, b: str, e: str) -> str:
    """Q at the parameters after an M-step, and the log likelihood there."""
    prior = "CASE WHEN z = 1 THEN ln(0.505e0) ELSE ln(0.495e0) END"
    x = f"(SELECT a.task_id, a.label, w.alpha * exp(t.beta) AS x FROM ann a JOIN {a} w USING (worker_id) JOIN {b} t USING (task_id))"
    up, down = "-ln(1e0 + exp(-x))", "-ln(1e0 + exp(x))"
    return f"""SELECT (SELECT sum(e.g * {up} + (1e0 - e.g) * {down}) FROM {x} r JOIN {e} e ON e.task_id = r.task_id AND e.z = r.label)
        + (SELECT sum(g * {prior}) FROM {e}) - (SELECT sum((alpha - 1) * (alpha - 1) / 2) FROM {a}) - (SELECT sum((beta - 1) * (beta - 1) / 2) FROM {b}) AS q,
      (SELECT sum(ln(exp(s0) + exp(s1))) FROM (SELECT task_id, ln(0.495e0) + sum(CASE WHEN label = 0 THEN {up} ELSE {down} END) AS s0,
         ln(0.505e0) + sum(CASE WHEN label = 1 THEN {up} ELSE {down} END) AS s1 FROM {x} r GROUP BY task_id) AS s)
        - (SELECT sum(0.5e0 * ln(2 * pi()) + (alpha - 1) * (alpha - 1) / 2) FROM {a})
        - (SELECT sum(0.5e0 * ln(2 * pi()) + (beta - 1) * (beta - 1) / 2) FROM {b}) AS llh"""


@query(
    "g12_glad_objective",
    f"""WITH {CONJUGATE_SQL}, o AS (SELECT 0 AS iter, * FROM ({_glad_objective('wa1', 'wb1', 'e1')}) AS x
        UNION ALL SELECT 1, * FROM ({_glad_objective('wa2', 'wb2', 'e2')}) AS x)
      SELECT iter, 'q' AS metric, round(q, 3) AS value FROM o UNION ALL SELECT iter, 'log_likelihood', round(llh, 3) FROM o""",
)
def g12b(spark, d):
    fit = glad(
        V.item_annotations(spark, d), rounds=1, threshold=0.0, inner_steps=3, step_size=0.5, solver="conjugate", logging_freq=1
    )
    return fit.trace.filter("metric IN ('q', 'log_likelihood')").select("iter", "metric", F.round("value", 3).alias("value"))


@query("g11_glad_prior_k3", f"WITH {glad_ctes(V3, 3, 1, 1, 0.5)} {labels_sql('e2')}")
def g11(spark, d):
    return _labels(_glad(spark, d, 3))


@query("g12_glad_trace")
def g12(spark, d):
    ann = V.item_annotations(spark, d)
    fit = glad(ann, rounds=1, threshold=0.0, inner_steps=1, gold=A.gold_labels(ann), logging_freq=1)
    return fit.trace


@query(
    "g13_glad_weights",
    f"WITH {GLAD_SQL} SELECT worker_id, round(alpha, 6) AS competence, round(alpha / sum(alpha) OVER (), 6) AS weight FROM a_end",
)
def g13(spark, d):
    return _glad(spark, d).workers.select(
        "worker_id", F.round("competence", 6).alias("competence"), F.round("weight", 6).alias("weight")
    )


def _mace(spark, d, k=2):
    return mace(V.item_annotations(spark, d, k), rounds=ROUNDS, variational=False)


@query("g14_mace_labels", f"WITH {mace_ctes(V2, 2, ROUNDS)} {labels_sql(f'e{ROUNDS}', hard_score=True)}")
def g14(spark, d):
    return _mace(spark, d).labels.select("task_id", "label", "score")


@query("g14_mace_labels_k3", f"WITH {mace_ctes(V3, 3, ROUNDS)} {labels_sql(f'e{ROUNDS}', hard_score=True)}")
def g14b(spark, d):
    return _mace(spark, d, 3).labels.select("task_id", "label", "score")


@query(
    "g14_mace_competence",
    f"WITH {mace_ctes(V2, 2, ROUNDS)} SELECT worker_id, round(1e0 - s, 6) AS competence FROM s{ROUNDS}",
)
def g14c(spark, d):
    return _mace(spark, d).workers.select("worker_id", F.round("competence", 6).alias("competence"))


@query(
    "g14_mace_entropy",
    f"WITH {mace_ctes(V2, 2, ROUNDS)} SELECT task_id, round(sum(CASE WHEN g > 0 THEN -g * ln(g) ELSE 0 END), 6) AS entropy FROM e{ROUNDS} GROUP BY 1",
)
def g14d(spark, d):
    return _mace(spark, d).tasks.select("task_id", F.round("entropy", 6).alias("entropy"))


@query("g14_mace_variational")
def g14e(spark, d):
    fit = mace(V.item_annotations(spark, d), rounds=ROUNDS, variational=True)
    return fit.workers.select("worker_id", F.round("competence", 6).alias("competence"))


STARTS = 2


def _mace_starts(spark, d):
    return mace(V.item_annotations(spark, d), rounds=ROUNDS, variational=False, restarts=STARTS)


@query("g14_mace_restarts", f"WITH {mace_restart_ctes(V2, 2, ROUNDS, STARTS)} {labels_sql('best', hard_score=True)}")
def g14f(spark, d):
    return _mace_starts(spark, d).labels.select("task_id", "label", "score")


@query(
    "g14_mace_restart_likelihoods",
    f"""WITH {mace_restart_ctes(V2, 2, ROUNDS, STARTS)}
    SELECT CAST({ROUNDS} AS INT) AS iter, 'log_likelihood_' || r AS metric, round(llh, 4) AS value FROM final
    UNION ALL SELECT CAST({ROUNDS} AS INT), 'chosen_start', CAST(r AS DOUBLE) FROM chosen""",
)
def g14g(spark, d):
    trace = _mace_starts(spark, d).trace.filter(F.col("iter") == ROUNDS)
    return trace.select("iter", "metric", F.round("value", 4).alias("value"))


@query(
    "g16_decode",
    f"WITH {ds_ctes(V3, 3, ROUNDS)}, g AS (SELECT task_id, CAST(z AS BIGINT) AS label, round(g, 6) AS p FROM e{ROUNDS}) SELECT * FROM g",
)
def g16(spark, d):
    fit = _ds(spark, d, 3)
    return fit.labels.select("task_id", F.posexplode("p").alias("label", "p")).select(
        "task_id", F.col("label").cast("long").alias("label"), F.round("p", 6).alias("p")
    )


@query("g17_stop_rule", f"WITH {ds_ctes(T1, 2, 16)} {likelihood_trace_sql(16, 1e-4)}")
def g17(spark, d):
    trace = dawid_skene(V.topic_tasks(spark, d), rounds=30, threshold=1e-4).trace
    return trace.select("iter", "metric", F.round("value", 4).alias("value"))


def _topic_inputs(spark, d):
    features, dims = V.task_features(spark, d)
    return V.topic_tasks(spark, d), features, dims


@query("g18_supervised")
def g18(spark, d):
    v1 = V.topic_annotations(spark, d)
    fold = A.topic_fold(A.topics(v1), 0, 2)
    features, _ = V.task_features(spark, d)
    keyed = v1.withColumn("task_id", A.task_key())
    train = A.keep_topics(keyed, fold.filter("part = 'train'"))
    test = A.keep_topics(keyed, fold.filter("part = 'test'"))
    cols = ("task_id", "worker_id", "label")
    fit = classifier_labels(
        train.select(*cols), features, A.gold_labels(train), test.select(*cols), features
    )
    return fit.labels.select("task_id", "label", F.round("score", 4).alias("score"))


def _scored(fit):
    return fit.labels.select("task_id", "label", F.round("score", 4).alias("score"))


@query("g19_feature_prior")
def g19(spark, d):
    return _scored(feature_prior(*_topic_inputs(spark, d), OneCoinWorker(init_competence=0.7), rounds=2))


@query("g20_prior_glad")
def g20(spark, d):
    return _scored(skill_prior(*_topic_inputs(spark, d), rounds=1, inner_steps=1))


@query("g21_prior_one_coin_workers")
def g21(spark, d):
    fit = feature_prior(*_topic_inputs(spark, d), OneCoinWorker(init_competence=0.7), rounds=2)
    return fit.workers.select("worker_id", F.round("competence", 4).alias("competence"))


@query("g22_prior_mace")
def g22(spark, d):
    return _scored(feature_prior(*_topic_inputs(spark, d), SpammerWorker(), rounds=2))


@query("g23_prior_ds")
def g23(spark, d):
    return _scored(feature_prior(*_topic_inputs(spark, d), ConfusionWorker(), rounds=2))


@query("g24_prior_noise")
def g24(spark, d):
    return _scored(noise_prior(*_topic_inputs(spark, d), rounds=1, inner_steps=1))


@query("g25_noise_model")
def g25(spark, d):
    return _scored(gaussian_noise(V.item_annotations(spark, d), steps=2))


@query("g26_prior_on_votes")
def g26(spark, d):
    fit = prior_on_votes(*_topic_inputs(spark, d), newton_steps=4)
    return fit.predictions.select("task_id", "label", F.round("mean", 4).alias("mean"), F.round("var", 4).alias("var"))


@query("g27_mean_function")
def g27(spark, d):
    ann, features, _ = _topic_inputs(spark, d)
    return mean_offset(features, ann, "logistic").select("task_id", F.round("shift", 4).alias("shift"))


@query("g28_feature_map")
def g28(spark, d):
    from tallyfold.models.probit import feature_map, mapped

    _, features, dims = _topic_inputs(spark, d)
    phi = mapped(features, feature_map(features, dims))
    return phi.select("task_id", F.size("phi").alias("dim"), F.round(F.aggregate("phi", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


F_BASE = f"""SELECT task_id, avg(CAST(label AS DOUBLE)) * 2 - 1 AS f_mean, var_pop(CAST(label AS DOUBLE)) + 0.1e0 AS f_var
  FROM ({V2}) AS v GROUP BY 1"""


def _f_base(spark, d):
    return V.item_annotations(spark, d).groupBy("task_id").agg(
        (F.avg("label") * 2 - 1).alias("f_mean"), (F.var_pop("label") + 0.1).alias("f_var")
    )


@query(
    "g29_predictive",
    f"""WITH b AS ({F_BASE}), p AS (SELECT task_id, {cdf('f_mean / sqrt(1e0 + f_var)')} AS p FROM b)
    SELECT task_id, round(p, 6) AS mean, round(p - p * p, 6) AS var, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS label FROM p""",
)
def g29(spark, d):
    p, v = predictive(F.col("f_mean"), F.col("f_var"))
    rows = _f_base(spark, d).select("task_id", p.alias("p"), v.alias("v"))
    return rows.select(
        "task_id", F.round("p", 6).alias("mean"), F.round("v", 6).alias("var"), F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("label")
    )


@query(
    "g30_probit_link",
    f"WITH b AS ({F_BASE}) SELECT task_id, round({link('f_mean * 3')}, 6) AS p1, round(1 - {link('f_mean * 3')}, 6) AS p0 FROM b",
)
def g30(spark, d):
    p = probit_link(F.col("f_mean") * 3)
    return _f_base(spark, d).select("task_id", F.round(p, 6).alias("p1"), F.round(1 - p, 6).alias("p0"))


NODES = ", ".join(f"({x!r}e0, {w!r}e0)" if "e" not in f"{x!r}{w!r}" else f"(CAST('{x!r}' AS DOUBLE), CAST('{w!r}' AS DOUBLE))" for x, w in zip(*gauss_hermite(20)))


@query(
    "g31_gaussian_expectation",
    f"""WITH b AS ({F_BASE}), n AS (SELECT * FROM (VALUES {NODES}) AS t(x, w)),
      s AS (SELECT task_id, w, f_mean + sqrt(f_var) * x AS f FROM b CROSS JOIN n)
    SELECT task_id, round(sum(w * ln({link('f')})), 6) AS value FROM s GROUP BY 1""",
)
def g31(spark, d):
    value = gaussian_expectation(lambda f: F.ln(probit_link(f)), F.col("f_mean"), F.col("f_var"))
    return _f_base(spark, d).select("task_id", F.round(value, 6).alias("value"))


LIK_SQL = f"""SELECT task_id, count(*) AS n_i, sum(ln(CASE WHEN label = 0 THEN 0.8e0 ELSE 0.2e0 END)) AS s0,
  sum(ln(CASE WHEN label = 1 THEN 0.8e0 ELSE 0.2e0 END)) AS s1 FROM ({V2}) AS v GROUP BY 1"""


def _lik(spark, d):
    def side(z):
        return F.sum(safe_ln(F.when(F.col("label") == z, F.lit(0.8)).otherwise(F.lit(0.2)))).alias(f"s{z}")

    return V.item_annotations(spark, d).groupBy("task_id").agg(F.count("*").alias("n_i"), side(0), side(1))


def _log_prior(spark, d):
    p = probit_link(F.col("f_mean"))
    return _f_base(spark, d).select("task_id", F.ln(1 - p).alias("lp0"), F.ln(p).alias("lp1"))


PRIOR_SQL = f"SELECT task_id, ln(1 - {link('f_mean')}) AS lp0, ln({link('f_mean')}) AS lp1 FROM ({F_BASE}) AS f"
_M = "greatest(s0 + {t} * lp0, s1 + {t} * lp1)"


def _marginal_sql(times: str) -> str:
    a, b = f"(s0 + {times} * lp0)", f"(s1 + {times} * lp1)"
    return f"greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b})))"


@query(
    "g32_log_marginal",
    f"""WITH l AS ({LIK_SQL}), p AS ({PRIOR_SQL}) SELECT l.task_id, round({_marginal_sql('1')}, 6) AS once,
      round({_marginal_sql('n_i')}, 6) AS per_label FROM l JOIN p ON p.task_id = l.task_id""",
)
def g32(spark, d):
    lik, prior = _lik(spark, d), _log_prior(spark, d)
    once = log_marginal(lik, prior, "once").withColumnRenamed("log_p", "once")
    per = log_marginal(lik, prior, "per_label").withColumnRenamed("log_p", "per_label")
    return once.join(per, "task_id").select("task_id", F.round("once", 6).alias("once"), F.round("per_label", 6).alias("per_label"))


@query(
    "g33_evidence_bound",
    f"""WITH l AS ({LIK_SQL}), p AS ({PRIOR_SQL}), q AS (SELECT task_id, avg(CASE WHEN label = 0 THEN 1e0 ELSE 0e0 END) AS g0,
        avg(CASE WHEN label = 1 THEN 1e0 ELSE 0e0 END) AS g1 FROM ({V2}) AS v GROUP BY 1)
    SELECT l.task_id, round(CASE WHEN g0 > 0 THEN g0 * (s0 + lp0 - ln(g0)) ELSE 0 END
      + CASE WHEN g1 > 0 THEN g1 * (s1 + lp1 - ln(g1)) ELSE 0 END, 6) AS bound
    FROM l JOIN p ON p.task_id = l.task_id JOIN q ON q.task_id = l.task_id""",
)
def g33(spark, d):
    q = V.item_annotations(spark, d).groupBy("task_id").agg(
        *[F.avg((F.col("label") == z).cast("double")).alias(f"g{z}") for z in (0, 1)]
    )
    out = evidence_bound(q, _lik(spark, d), _log_prior(spark, d))
    return out.select("task_id", F.round("bound", 6).alias("bound"))


@query("g34_partial_refit")
def g34(spark, d):
    ann, features, dims = _topic_inputs(spark, d)
    first = feature_prior(ann, features, dims, OneCoinWorker(init_competence=0.7), rounds=1)
    again = feature_prior(
        ann, features, dims, OneCoinWorker(init_competence=0.7), rounds=1,
        freeze="workers", start_params=first.params, start_weights=first.weights,
    )
    return again.workers.select("worker_id", F.round("competence", 4).alias("competence"))


@query("h08_compare_models")
def h08(spark, d):
    from tallyfold.plans.scoring import rounded_report

    ann = V.topic_tasks(spark, d)
    fixed = {"rounds": ROUNDS, "threshold": None}
    report = compare_models(
        ann, A.gold_labels(ann), ["mv", "ds", "zc"], options={"ds": fixed, "zc": fixed}
    )
    return report.select("model", *[c for c in report.columns if c in ("tn", "fp", "fn", "tp", "acc", "auc")])


class BiasedCoin(WorkerModel):
    """Example of a user model: one competence per worker, shrunk towards 0.7."""

    name = "shrunk"

    def init_columns(self):
        return {"skill": F.lit(0.7)}

    def likelihood(self, truth):
        return F.when(F.col("label") == truth, F.col("skill")).otherwise((1 - F.col("skill")) / (self.k - 1))

    def m_step_aggs(self):
        return [F.sum(own_posterior(self.k)).alias("right"), F.count("*").alias("n")]

    def m_step_columns(self):
        return {"skill": (F.col("right") + 7.0) / (F.col("n") + 10.0)}

    def worker_table(self, params):
        return params.select("worker_id", "skill")


@query(
    "i01_custom_worker_model",
    f"WITH {shrunk_coin_ctes(V2, 2, 2, 0.7, 10.0)} SELECT worker_id, round(c, 6) AS skill FROM c2",
)
def i01(spark, d):
    fit = fit_em(V.item_annotations(spark, d), BiasedCoin(), rounds=2, threshold=None)
    return fit.workers.select("worker_id", F.round("skill", 6).alias("skill"))
