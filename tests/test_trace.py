"""Traces of fits: metrics observed by the jobs that write the tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from tallyfold.models.em import label_metrics
from tallyfold.models.probit import feature_prior
from tallyfold.models.variational import variational_prior
from tallyfold.models.workers import OneCoinWorker, dawid_skene
from tallyfold.operators.evaluation import auc, class_scores
from tallyfold.session import Scratch, watched

SCHEMA = "task_id long, worker_id string, label int"


@pytest.fixture(scope="module")
def ann(spark):
    rows = [(t, f"w{w}", (t + (w * t % 5 == 0)) % 2) for t in range(40) for w in range(1, 6)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame([(t, t % 2) for t in range(40)], "task_id long, gold int")


def jobs(spark, run):
    """Number of Spark jobs of a call; without adaptive execution every action is one."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    sc.setJobGroup(group, "counted")
    try:
        run()
        return len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_round_writes_its_parameters_and_takes_no_other_action(spark, ann):
    n = {r: jobs(spark, lambda r=r: dawid_skene(ann, rounds=r, threshold=None)) for r in (1, 3)}
    # one write and the schema of the written table
    assert (n[3] - n[1]) / 2 <= 2, n


def test_watched_sums_are_those_of_the_table(spark):
    scratch = Scratch(spark)
    table, seen = watched(scratch.cut, spark.range(1000).repartition(7), [F.sum("id").alias("s"), F.count("*").alias("n")])
    assert (seen["s"], seen["n"], table.count()) == (499500, 1000, 1000)
    empty, seen = watched(scratch.cut, spark.range(0), [F.sum("id").alias("s"), F.count("*").alias("n")])
    assert (seen["s"], seen["n"], empty.count()) == (None, 0, 0)


def test_metrics_of_labels(spark, ann, gold):
    fit = dawid_skene(ann, rounds=2, threshold=None, gold=gold, logging_freq=1)
    last = {m: v for i, m, v in fit.trace_rows if i == 2}
    pred = fit.labels.join(gold, "task_id").select("gold", F.col("label").alias("pred"), "score")
    want = {**class_scores(pred).first().asDict(), **auc(pred).first().asDict()}
    for name in ("tn", "fp", "fn", "tp", "acc", "posi_f1", "nega_f1", "auc"):
        assert last[name] == pytest.approx(want[name]), name
    got = dict((m, v) for _, m, v in label_metrics(1, fit.labels, gold.limit(0)))
    assert got["acc"] == 0 and got["tp"] == 0 and "auc" not in got


def test_parameter_errors_need_no_gold(spark, ann):
    ref = ann.select("worker_id").distinct().withColumn("truth", F.lit(0)).withColumn("label", F.lit(0)).withColumn("ref", F.lit(1.0))
    fit = dawid_skene(ann, rounds=2, threshold=None, ref_params={"p": ref}, logging_freq=2)
    assert [(i, m) for i, m, _ in fit.trace_rows if m != "log_likelihood"] == [(1, "p_mse")]


def test_feature_models_report_too(spark, ann, gold):
    features = spark.createDataFrame([(t, [float(t % 2) - 0.5]) for t in range(40)], "task_id long, features array<double>")
    ref = ann.select("worker_id").distinct().withColumn("ref", F.lit(0.9))
    how = {"rounds": 2, "threshold": None, "gold": gold, "ref_params": {"competence": ref}, "logging_freq": 1}
    for fit in (feature_prior, variational_prior):
        rows = fit(ann, features, {"linear": [0]}, OneCoinWorker(init_competence=0.7), **how).trace_rows
        names = {(i, m) for i, m, _ in rows}
        assert {(i, m) for i in (1, 2) for m in ("acc", "auc", "tp", "competence_mse", "evidence_bound")} <= names, fit


def test_no_annotations_is_an_error(spark):
    with pytest.raises(ValueError, match="no annotations"):
        dawid_skene(spark.createDataFrame([], SCHEMA), labels=[0, 1])
