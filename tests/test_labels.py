"""Hand-computed tables and invariants of the label models."""

import math

import pytest
from pyspark.sql import functions as F

from tallyfold.models.compare import compare_models, prediction_table, run_model
from tallyfold.models.em import WorkerModel, fit_em, relative_change_below
from tallyfold.models.glad import glad
from tallyfold.models.majority import majority_vote, plurality_vote, require_labels
from tallyfold.models.workers import dawid_skene, mace, one_coin
from tallyfold.operators.annotations import canonical, gold_labels
from tallyfold.operators.evaluation import class_scores
from tallyfold.plans import views as V

SF = "/root/testdata/sf0.001"
SCHEMA = "task_id string, worker_id int, label int"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def as_dict(df, *cols):
    return {r[0]: r[1] for r in df.select(*cols).collect()}


def test_majority_tie_is_relevant(spark):
    ann = table(spark, [("a", 1, 1), ("a", 2, 0), ("b", 1, 0), ("b", 2, 0), ("c", 1, 7)])
    assert as_dict(majority_vote(ann), "task_id", "label") == {"a": 1, "b": 0, "c": 1}
    assert as_dict(plurality_vote(ann), "task_id", "label") == {"a": 1, "b": 0, "c": 7}


def test_task_without_labels_is_an_error(spark):
    tasks = spark.createDataFrame([("a",), ("z",)], "task_id string")
    with pytest.raises(ValueError):
        require_labels(table(spark, [("a", 1, 1)]), tasks)


def test_contradictory_duplicates(spark):
    ann = table(spark, [("a", 1, 0), ("a", 1, 1), ("a", 2, 0)])
    assert as_dict(majority_vote(canonical(ann, "distinct")), "task_id", "label") == {"a": 0}
    assert as_dict(majority_vote(canonical(ann, "max")), "task_id", "label") == {"a": 1}


class FixedTable(WorkerModel):
    """Workers 1 and 2 exclude truth 1 and truth 0 respectively."""

    name = "fixed"

    def init_columns(self):
        return {"id": F.lit(0)}

    def likelihood(self, truth):
        return F.when(F.col("worker_id") == truth + 1, F.lit(1.0)).otherwise(F.lit(0.0))

    def m_step_aggs(self):
        return [F.count("*").alias("n")]

    def m_step_columns(self):
        return {"id": F.lit(0)}


def test_all_zero_posterior_is_uniform(spark):
    ann = table(spark, [("a", 1, 0), ("a", 2, 1), ("b", 1, 0)])
    fit = fit_em(ann, FixedTable(), labels=[0, 1], rounds=1, threshold=None)
    p = {r["task_id"]: r["p"] for r in fit.labels.collect()}
    assert p["a"] == [0.5, 0.5]
    assert p["b"] == [1.0, 0.0]


def test_stop_rule():
    assert not relative_change_below(1.0, 2.0, None)
    assert relative_change_below(1.00001, 1.0, 1e-4)
    assert relative_change_below(0.0, 0.0, 1e-4) and not relative_change_below(1.0, 0.0, 1e-4)


@pytest.fixture(scope="module")
def items(spark):
    return V.item_annotations(spark, SF).cache()


@pytest.mark.parametrize("fit", [dawid_skene, one_coin])
def test_likelihood_never_falls_and_posteriors_sum_to_one(spark, items, fit):
    out = fit(items, rounds=4, threshold=None)
    values = [v for _, _, v in out.trace_rows]
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(values, values[1:]))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    assert out.labels.filter(F.abs(total - 1) > 1e-9).count() == 0


def test_competence_recovers_known_accuracy(spark, items):
    out = one_coin(items, rounds=5, threshold=1e-6)
    truth = items.groupBy("worker_id").agg(F.avg((F.col("gold") == F.col("label")).cast("int")).alias("ref"))
    assert out.workers.join(truth, "worker_id").agg(F.corr("ref", "competence")).first()[0] > 0.95


@pytest.fixture(scope="module")
def crowded(spark):
    """One task and one worker with most of the labels."""
    rows = [("hot", w, int(w % 4 != 0)) for w in range(60)] + [(f"t{i}", 1, i % 2) for i in range(60)]
    rows += [(f"t{i}", 2 + i % 7, (i + i % 3 // 2) % 2) for i in range(60)]
    return spark.createDataFrame(rows, "task_id string, worker_id int, label int").distinct().persist()


FITS = {
    "ds": lambda a, n: dawid_skene(a, rounds=2, threshold=None, rows_per_part=n),
    "zc": lambda a, n: one_coin(a, rounds=2, threshold=None, rows_per_part=n),
    "mace": lambda a, n: mace(a, rounds=2, rows_per_part=n),
    "glad": lambda a, n: glad(a, rounds=1, threshold=None, inner_steps=1, step_size=0.5, rows_per_part=n),
}


@pytest.mark.parametrize("name", FITS)
def test_split_hot_keys_give_the_same_answer(spark, crowded, name):
    plain, split = FITS[name](crowded, 10**6), FITS[name](crowded, 20)
    both = plain.labels.alias("a").join(split.labels.alias("b"), "task_id")
    assert both.filter(F.abs(F.col("a.score") - F.col("b.score")) > 1e-9).count() == 0
    assert both.count() == plain.labels.count() == 61


def test_labels_outside_the_list_are_an_error(spark):
    ann = table(spark, [("a", 1, 1), ("a", 2, 0), ("b", 1, 2), ("b", 2, 1)])
    with pytest.raises(Exception, match="label not among"):
        dawid_skene(ann, labels=[0, 1], rounds=1, threshold=None).labels.collect()
    with pytest.raises(ValueError, match="rounds"):
        dawid_skene(ann, rounds=0)


def test_parameter_error_of_a_table_against_itself_is_zero(spark, items):
    from tallyfold.models.em import param_metrics

    for fit, name in ((dawid_skene(items, rounds=1, threshold=None), "p"), (mace(items, rounds=1), "strategy")):
        ref = fit.workers.withColumnRenamed(name, "ref")
        assert param_metrics(1, fit.workers, {name: ref}) == [(1, f"{name}_mse", 0.0)]


def test_partition_count_does_not_matter(spark, items):
    one = as_dict(one_coin(items, rounds=1, threshold=None).workers, "worker_id", "competence")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        other = as_dict(one_coin(items, rounds=1, threshold=None).workers, "worker_id", "competence")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert one.keys() == other.keys()
    assert all(math.isclose(one[w], other[w], rel_tol=1e-9) for w in one)


def test_single_worker_keeps_its_labels(spark):
    ann = table(spark, [("a", 1, 1), ("b", 1, 0), ("c", 1, 1)])
    assert as_dict(dawid_skene(ann, rounds=3, threshold=None).labels, "task_id", "label") == {"a": 1, "b": 0, "c": 1}


def test_glad_objective_rises_and_perfect_worker_is_finite(spark):
    rows = [(t, w, int(t in "ab")) for t in "abcd" for w in (1, 2)] + [("a", 3, 0), ("c", 3, 1)]
    fit = glad(table(spark, rows), rounds=2, threshold=0.0, inner_steps=2)
    alpha = as_dict(fit.workers, "worker_id", "competence")
    assert all(math.isfinite(v) for v in alpha.values())
    assert alpha[1] > alpha[3]
    assert as_dict(fit.labels, "task_id", "label") == {"a": 1, "b": 1, "c": 0, "d": 0}


def test_mace_outputs(spark, items):
    fit = mace(items, rounds=3)
    assert fit.tasks.filter((F.col("entropy") < 0) | (F.col("entropy") > 0.6932)).count() == 0
    assert fit.workers.filter(~F.col("competence").between(0, 1)).count() == 0
    gold = gold_labels(items)
    assert class_scores(prediction_table(fit, gold)).first()["acc"] > 0.97


def test_compare_and_dispatch(spark, items):
    report = compare_models(items, gold_labels(items), ["mv", "zc"], options={"zc": {"rounds": 1, "threshold": None}})
    assert {r["model"] for r in report.collect()} == {"mv", "zc"}
    with pytest.raises(ValueError):
        run_model("nope", items)


def test_round_plan_shuffles_annotations_once(spark, items):
    """Inside a round only the aggregate by worker moves data."""
    from tallyfold.models.em import Layout, maximise, posterior
    from tallyfold.models.workers import ConfusionWorker
    from tallyfold.session import Scratch

    scratch, model = Scratch(spark), ConfusionWorker()
    layout = Layout(canonical(items), scratch)
    init = [c.alias(n) for n, c in model.init_columns().items()]
    params = scratch.cut(layout.workers().select("worker_id", *init), "params")
    post = posterior(layout, params, [model.likelihood(t) for t in (0, 1)], [0.5, 0.5])
    plan = maximise(layout, params, post, model)._jdf.queryExecution().sparkPlan().toString()
    executed = maximise(layout, params, post, model)._jdf.queryExecution().executedPlan().toString()
    layout.close()
    assert plan
    shuffles = [x for x in executed.splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" not in x]
    assert len(shuffles) == 1 and "worker_id" in shuffles[0]


def test_restarts_equal_separate_fits(spark, items):
    """Start 0 is the single fit; every start equals a fit of its own; the likeliest wins."""
    from tallyfold.models.em import Layout, index_labels
    from tallyfold.models.restarts import best_start, e_step, m_step, one_start, start_table
    from tallyfold.models.workers import SpammerWorker
    from tallyfold.session import Scratch

    single, both = mace(items, rounds=3), mace(items, rounds=3, restarts=3)
    last = {r["metric"]: r["value"] for r in both.trace.filter("iter = 3").collect()}
    alone = single.trace.filter("iter = 3 and metric = 'log_likelihood'").first()["value"]
    assert last["log_likelihood_0"] == pytest.approx(alone, abs=1e-9)
    values = [last[f"log_likelihood_{r}"] for r in range(3)]
    assert last["chosen_start"] == best_start(values) and len({round(v, 6) for v in values}) == 3

    # three starts side by side and start 2 alone go through the same parameters
    scratch, model = Scratch(spark), SpammerWorker(variational=True)
    layout = Layout(index_labels(canonical(items, "max"), [0, 1]), scratch)
    wide = start_table(layout.workers(), 2, 3, 0.5, 0)
    third = one_start(wide, 2).select("worker_id", *[F.col(c).alias(f"{c}_0") for c in ("spamming", "copying", "strategy")])
    for _ in range(2):
        wide = scratch.cut(m_step(layout, wide, e_step(layout, wide, 2, 3, False), model, 3))
        third = scratch.cut(m_step(layout, third, e_step(layout, third, 2, 1, False), model, 1))
    a, b = as_dict(wide, "worker_id", "spamming_2"), as_dict(third, "worker_id", "spamming_0")
    assert a.keys() == b.keys() and all(a[w] == pytest.approx(b[w], abs=1e-12) for w in a)
    layout.close()


def test_restarts_share_one_shuffle(spark, items):
    from tallyfold.models.em import Layout, index_labels
    from tallyfold.models.restarts import e_step, m_step, start_table
    from tallyfold.models.workers import SpammerWorker
    from tallyfold.session import Scratch

    scratch = Scratch(spark)
    layout = Layout(index_labels(canonical(items, "max"), [0, 1]), scratch)
    for restarts in (1, 4):
        params = scratch.cut(start_table(layout.workers(), 2, restarts, 0.5, 0))
        plan = m_step(layout, params, e_step(layout, params, 2, restarts, False), SpammerWorker(), restarts)
        executed = plan._jdf.queryExecution().executedPlan().toString()
        shuffles = [x for x in executed.splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" not in x]
        assert len(shuffles) == 1 and "worker_id" in shuffles[0]
    layout.close()


def test_restarts_edges(spark, crowded):
    plain = mace(crowded, rounds=2, restarts=2, rows_per_part=10**6)
    split = mace(crowded, rounds=2, restarts=2, rows_per_part=20)
    both = plain.tasks.alias("a").join(split.tasks.alias("b"), "task_id")
    assert both.count() == 61 and both.filter(F.abs(F.col("a.entropy") - F.col("b.entropy")) > 1e-9).count() == 0
    empty = mace(crowded.filter("false"), rounds=2, restarts=2, labels=[0, 1])
    assert empty.labels.count() == empty.workers.count() == 0
    noted = crowded.unionByName(spark.createDataFrame([("t1", 99, None), ("n", None, 1)], crowded.schema))
    # a null label or worker is no annotation
    assert mace(noted, rounds=2, restarts=2).labels.count() == 61
    with pytest.raises(ValueError, match="noise"):
        mace(crowded, restarts=2, noise=1.0)
