"""Fitted classifiers score by plain expressions, so no plan holds the model."""

import pytest


def _tables(spark):
    rows = [(f"t{i}", w, int((i * 7 + w) % 5 < 2 + i % 2)) for i in range(40) for w in range(3)]
    ann = spark.createDataFrame(rows, "task_id string, worker_id long, label int")
    feats = spark.createDataFrame([(f"t{i}", [float(i % 2), i / 40]) for i in range(40)], "task_id string, features array<double>")
    gold = spark.createDataFrame([(f"t{i}", i % 2) for i in range(40)], "task_id string, gold int")
    return ann, feats, gold


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_classifier_scores_without_model_in_plan(spark):
    from pyspark.ml.classification import LogisticRegression

    from tallyfold.models import supervised as S

    ann, feats, gold = _tables(spark)
    out = S.classifier_labels(ann, feats, gold, ann, feats).labels
    assert "rawPrediction" not in _plan(out)
    train = S.design(ann, feats).join(gold, "task_id").selectExpr("x", "double(gold) AS y", "task_id")
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / 40, standardization=False, maxIter=10000, tol=1e-6).fit(train)
    want = {r.task_id: (int(r.prediction), float(r.probability[1])) for r in model.transform(train).collect()}
    got = {r.task_id: (r.label, r.score) for r in out.collect()}
    assert got.keys() == want.keys()
    for k, (label, score) in got.items():
        assert label == want[k][0] and score == pytest.approx(want[k][1], abs=1e-5)


def test_training_runs_over_a_written_table(spark):
    from tallyfold.models import supervised as S

    ann, feats, gold = _tables(spark)
    rows = S.design(ann, feats).join(gold, "task_id").selectExpr("x", "gold AS y")
    plan = _plan(S.training_table(rows))
    assert "Join" not in plan and "Relation" in plan and S.training_table(rows).count() == 40
