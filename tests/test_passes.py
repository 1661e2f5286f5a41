"""Passes over all annotations that need not be made twice."""

import pytest
from pyspark.sql import functions as F

from tallyfold.models import glad as G
from tallyfold.models.compare import compare_models
from tallyfold.models.em import Layout
from tallyfold.session import Scratch

ROWS = [(t, w, int((t * 7 + w * 3) % 10 < 7) ^ (t % 2), t % 2) for t in range(20) for w in range(5)]


def _ann(spark):
    return spark.createDataFrame(ROWS, "task_id long, worker_id long, label int, gold int")


def test_report_reads_written_tables_only(spark, tmp_path):
    _ann(spark).write.parquet(str(tmp_path / "ann"))
    ann = spark.read.parquet(str(tmp_path / "ann"))
    # rows that come twice do not count twice
    ann = ann.unionByName(ann)
    gold = ann.groupBy("task_id").agg(F.max("gold").alias("gold"))
    out = compare_models(ann, gold, ["mv", "ds"], options={"ds": {"rounds": 1, "threshold": None}})
    assert not [f for f in out.inputFiles() if str(tmp_path) in f]
    votes = {t: sum(y for u, _, y, _ in ROWS if u == t) for t in range(20)}
    hits = sum((2 * votes[t] >= 5) == (t % 2) for t in range(20))
    assert out.filter("model = 'mv'").first()["acc"] == pytest.approx(hits / 20)


def test_rows_are_sorted_once(spark):
    ann = _ann(spark).select("task_id", "worker_id", "label")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    layout = Layout(ann, Scratch(spark))
    try:
        tasks = Scratch(spark).cut(ann.groupBy("task_id").agg(F.count("*").alias("n")))
        both = layout.with_tasks(layout.ann, tasks)
        assert both.count() == len(ROWS)
        plan = both._jdf.queryExecution().executedPlan().toString()
        # above the cached rows nothing but the small side is sorted; the cached plan itself has one more
        above = plan.split("InMemoryRelation")[0]
        assert "SortMergeJoin" in plan and above.count("Sort [") == 0
    finally:
        layout.close()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_ascent_objective_comes_from_the_line_search(spark, monkeypatch):
    how = {"rounds": 1, "threshold": 0.0, "inner_steps": 2, "solver": "ascent"}
    taken = []
    ascend = G.ascend

    def watch(layout, scratch, model, workers, tasks, data, *rest):
        out = ascend(layout, scratch, model, workers, tasks, data, *rest)
        taken.append(G_objective(layout, model, out[0], out[1], data))
        assert out[2][-1] == pytest.approx(taken[-1], rel=1e-9)
        return out

    G_objective = G.objective
    monkeypatch.setattr(G, "ascend", watch)
    monkeypatch.setattr(G, "objective", lambda *a: pytest.fail("one more pass"))
    fit = G.glad(_ann(spark), **how)
    assert len(taken) == 2 and len([m for _, m, _ in fit.trace_rows if m == "q"]) == 2
