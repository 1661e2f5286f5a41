"""The logistic mean function scores by a plain expression."""

from test_supervised import _plan, _tables


def test_logistic_mean_without_model_in_plan(spark):
    from tallyfold.models.probit import mean_offset

    ann, feats, _ = _tables(spark)
    out = mean_offset(feats, ann, "logistic")
    assert "rawPrediction" not in _plan(out) and "prob#" not in _plan(out)
    assert out.filter("shift IS NULL").count() == 0 and out.count() == 40
