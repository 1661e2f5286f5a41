"""Models of one comparison are fitted side by side, and no model deals the labels out again to pick one of a worker."""

import threading

import pytest

from tallyfold.models import compare as C
from tallyfold.operators import annotations as A


def _labels(spark):
    rows = [(i % 4, w, i % 2, (i + w % 2) % 2) for i in range(8) for w in range(5)] * 2
    return spark.createDataFrame(rows, "task_id long, worker_id long, gold int, label int")


def test_two_models_are_under_way_at_once(spark, monkeypatch):
    both, plans = threading.Barrier(2, timeout=60), []

    def waits(ann, **kw):
        both.wait()
        plans.append(A.canonical(ann, "max")._jdf.queryExecution().executedPlan().toString())
        return C.majority(ann)

    monkeypatch.setitem(C.PLAIN, "mv", waits)
    monkeypatch.setitem(C.PLAIN, "zc", waits)
    ann = _labels(spark)
    out = C.compare_models(ann, A.gold_labels(ann), ["zc", "mv"]).collect()
    assert [r.model for r in out] == ["zc", "mv"] and out[0][1:] == out[1][1:] and sum(out[0][1:5]) == 4
    assert not [p for p in plans if "Exchange" in p]


def test_an_error_of_one_model_is_raised(spark):
    ann = _labels(spark)
    with pytest.raises(ValueError, match="unknown model"):
        C.compare_models(ann, A.gold_labels(ann), ["mv", "nosuch"])
