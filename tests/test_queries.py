"""Registered queries against their SQL.  ALL_QUERIES=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from compare import differences, duck

SF = "/root/testdata/sf0.001"
SOME = (
    "a01_read_annotations a07_read_runs b03_clean_text b06_profile_filter c01_join_statistics d04_majority_vote "
    "d09_label_quality e01_rerank_runs e04_topic_folds f02_porter_stem f11_bm25_score f17_rank_sum g03_ds_posterior "
    "g08_zc_competence_k3 g09_glad_labels g14_mace_labels_k3 g15_acquisition_scores g31_gaussian_expectation "
    "g32_log_marginal h07_evaluation_report"
).split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def names():
    sql = entry.oracle_sql()
    return sorted(sql) if os.environ.get("ALL_QUERIES") else SOME


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, con, name):
    assert differences(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_entry_row(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["acc"] > 0.9


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_prior_models_beat_chance(spark):
    from tallyfold.models.probit import feature_prior, prior_on_votes
    from tallyfold.models.workers import OneCoinWorker
    from tallyfold.operators.annotations import gold_labels
    from tallyfold.operators.evaluation import class_scores
    from tallyfold.models.compare import prediction_table
    from tallyfold.plans import views as V

    ann = V.topic_tasks(spark, SF)
    features, dims = V.task_features(spark, SF)
    fit = feature_prior(ann, features, dims, OneCoinWorker(init_competence=0.7), rounds=3, threshold=None)
    assert class_scores(prediction_table(fit, gold_labels(ann))).first()["acc"] > 0.9
    values = [v for _, _, v in fit.trace_rows]
    assert values[-1] > values[0]
    assert prior_on_votes(ann, features, dims, newton_steps=2).predict_new(features).count() == features.count()
