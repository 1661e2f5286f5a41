"""Expectation-maximisation over long-form annotations.

One round is one Spark job.  Annotations are hash-partitioned by task once and
persisted; the small parameter table of the previous round joins in (broadcast
only when its written size allows it), the posterior is an aggregate by task
that reuses the partitioning, and the only shuffle is the map-side combined
aggregate by worker.  Tasks that own a disproportionate share of the labels are
split into parts first.

Global totals (label shares, log evidence) ride on the same aggregate: every
annotation row carries ``1 / n_i`` of its task, so sums over rows are sums over
tasks, and the driver only ever sees K + 1 scalars per round.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from tallyfold.models.rounds import Rounds, identity
from tallyfold.operators import skew
from tallyfold.operators.annotations import canonical
from tallyfold.session import Scratch, shuffle_partitions, watched

MAX_LABELS = 64


class WorkerModel:
    """How a worker turns a true label into an annotation.

    A model is a few Column expressions over the columns ``label``, ``g0..gK-1``
    (posterior, M-step only) and its own parameter columns, so user models stay
    inside Catalyst.
    """

    name = "custom"
    # rounds run before the first counted one
    warmup = 0
    # whether m_step_aggs uses the previous parameters
    m_step_reads_params = False

    def __init__(self, k: int = 2):
        self.k = k

    def init_columns(self) -> dict[str, Column]:
        """Starting parameters of every worker."""
        raise NotImplementedError

    def likelihood(self, truth: int) -> Column:
        """p(label | truth, worker)."""
        raise NotImplementedError

    def m_step_aggs(self) -> list[Column]:
        """Aggregates per worker, each aliased."""
        raise NotImplementedError

    def m_step_columns(self) -> dict[str, Column]:
        """New parameters from the aggregates."""
        raise NotImplementedError

    def worker_table(self, params: DataFrame) -> DataFrame:
        """Public form of the parameters."""
        return params.select("worker_id", *self.init_columns())


@dataclass
class Fit:
    """Result of a label-aggregation model."""

    model: str
    labels: DataFrame  # task_id, label, score, p
    workers: DataFrame  # worker_id + parameters
    tasks: DataFrame | None = None  # task_id + parameters
    trace_rows: list[tuple[int, str, float]] = field(default_factory=list)
    prior: list[float] | None = None

    @property
    def trace(self) -> DataFrame:
        """``(iter, metric, value)``; a handful of scalars per round."""
        spark = self.labels.sparkSession
        return spark.createDataFrame(self.trace_rows, "iter int, metric string, value double")


def relative_change_below(now: float, before: float, threshold: float | None) -> bool:
    """Stop rule of every fit."""
    if threshold is None:
        return False
    if before == 0:
        return now == 0
    return abs((now - before) / before) < threshold


def infer_labels(ann: DataFrame) -> list[int]:
    rows = ann.select("label").distinct().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} distinct labels")
    return sorted(int(r[0]) for r in rows)


class Layout:
    """Annotations arranged for repeated passes: by task, hot tasks split in parts."""

    def __init__(
        self,
        ann: DataFrame,
        scratch: Scratch,
        rows_per_part: int = skew.ROWS_PER_PART,
    ):
        spark = ann.sparkSession
        base = scratch.cut(ann.select("task_id", "worker_id", F.col("label").cast("int").alias("label")), "ann")
        n = shuffle_partitions(spark)
        self.split = self.split_workers = False
        # with so few rows no key can be hot; the count comes from file footers
        self.rows = base.count()
        if self.rows > rows_per_part:
            self.hot = scratch.cut(skew.hot_keys(base, "task_id", rows_per_part), "hot-tasks")
            self.split = not self.hot.isEmpty()
            self.hot_workers = scratch.cut(skew.hot_keys(base, "worker_id", rows_per_part), "hot-workers")
            self.split_workers = not self.hot_workers.isEmpty()
        self.keys = ["task_id"]
        if self.split:
            base = skew.spread(base, "task_id", "worker_id", self.hot, "part")
            self.keys = ["task_id", "part"]
        if self.split_workers:
            base = skew.spread(base, "worker_id", "task_id", self.hot_workers, "wpart")
        # sorted once, so that no pass sorts the rows again to join them with values by task
        self.ann = base.repartition(n, *self.keys).sortWithinPartitions(*self.keys).persist(StorageLevel.MEMORY_AND_DISK)

    def with_workers(self, rows: DataFrame, params: DataFrame) -> DataFrame:
        """Attach worker parameters to annotation rows."""
        if not self.split_workers:
            return rows.join(params, "worker_id")
        right = skew.repeat(params, "worker_id", self.hot_workers, "wpart")
        return rows.join(right, ["worker_id", "wpart"])

    def by_task(self, rows: DataFrame, aggs: Sequence[Column], merge: Sequence[Column]) -> DataFrame:
        """Aggregate rows to tasks; ``merge`` combines the parts of a split task."""
        per_part = rows.groupBy(*self.keys).agg(*aggs)
        return per_part.groupBy("task_id").agg(*merge) if self.split else per_part

    def with_tasks(self, rows: DataFrame, per_task: DataFrame) -> DataFrame:
        """Attach one-row-per-task values to annotation rows."""
        if not self.split:
            return rows.join(per_task, "task_id")
        return rows.join(skew.repeat(per_task, "task_id", self.hot, "part"), self.keys)

    def workers(self) -> DataFrame:
        return self.ann.select("worker_id").distinct()

    def close(self) -> None:
        self.ann.unpersist()


def posterior(
    layout: Layout,
    params: DataFrame,
    likelihood: Sequence[Column],
    prior: Sequence[float] | None,
    task_prior: DataFrame | None = None,
    task_params: DataFrame | None = None,
) -> DataFrame:
    """E-step: ``(task_id, g0..gK-1, n_i, evidence)``.

    Zero probabilities are counted, not logged: a truth excluded by any label
    gets weight 0, and a task whose truths are all excluded is uniform.  The
    per-task log prior comes from ``task_prior`` (``lp0..``) or from ``prior``.
    """
    k = len(likelihood)
    rows = layout.with_workers(layout.ann, params)
    if task_params is not None:
        rows = layout.with_tasks(rows, task_params)
    lik = rows.select(*layout.keys, *[c.alias(f"l{i}") for i, c in enumerate(likelihood)])
    # framework steps as SQL text: one call per step instead of one per operator
    aggs, merge = ["count(*) AS n_i"], ["sum(n_i) AS n_i"]
    for i in range(k):
        aggs += [
            f"sum(CASE WHEN l{i} > 0 THEN ln(l{i}) END) AS s{i}",
            f"sum(CAST(l{i} <= 0 AS BIGINT)) AS z{i}",
        ]
        merge += [f"sum(s{i}) AS s{i}", f"sum(z{i}) AS z{i}"]
    sums = layout.by_task(lik, [F.expr(a) for a in aggs], [F.expr(m) for m in merge])
    if task_prior is not None:
        sums = sums.join(task_prior, "task_id", "left")
        log_prior = [f"coalesce(lp{i}, {-math.log(k)!r}D)" for i in range(k)]
    else:
        # one row of K numbers, joined rather than inlined so that generated code is reused
        cells = [f"{math.log(p)!r}D" if p > 0 else "CAST(NULL AS DOUBLE)" for p in prior]
        names = ", ".join(["one", *[f"lp{i}" for i in range(k)]])
        row = params.sparkSession.sql(f"SELECT * FROM VALUES (1, {', '.join(cells)}) AS t({names})")
        sums = sums.withColumn("one", F.lit(1)).join(F.broadcast(row), "one")
        log_prior = [f"lp{i}" for i in range(k)]
    each = range(k)
    total = " + ".join(f"e{i}" for i in each)
    return (
        sums.selectExpr(
            "task_id",
            "n_i",
            *[f"CASE WHEN z{i} = 0 THEN coalesce(s{i}, 0D) + {log_prior[i]} END AS w{i}" for i in each],
        )
        .selectExpr("*", f"greatest({', '.join(f'w{i}' for i in each)}) AS m")
        .selectExpr("task_id", "n_i", "m", *[f"coalesce(exp(w{i} - m), 0D) AS e{i}" for i in each])
        .selectExpr(
            "task_id",
            *[f"CASE WHEN m IS NULL THEN {1.0 / k!r}D ELSE e{i} / ({total}) END AS g{i}" for i in each],
            "n_i",
            f"CASE WHEN m IS NULL THEN 0D ELSE m + ln({total}) END AS evidence",
        )
    )


def step_columns(model: WorkerModel) -> tuple[list[Column], list[Column]]:
    """Aggregates and parameter columns of an M-step, built once per fit."""
    shares = [f"sum(g{i} / n_i) AS tot_g{i}" for i in range(model.k)] + ["sum(evidence / n_i) AS tot_ev"]
    aggs = [*model.m_step_aggs(), *[F.expr(s) for s in shares]]
    new = [c.alias(name) for name, c in model.m_step_columns().items()]
    return aggs, [F.col("worker_id"), *new, *[F.col(f"tot_g{i}") for i in range(model.k)], F.col("tot_ev")]


def maximise(
    layout: Layout,
    params: DataFrame,
    post: DataFrame,
    model: WorkerModel,
    columns: tuple[list[Column], list[Column]] | None = None,
) -> DataFrame:
    """M-step: new worker parameters, plus each worker's share of the global totals."""
    aggs, out = columns or step_columns(model)
    rows = layout.with_workers(layout.ann, params) if model.m_step_reads_params else layout.ann
    return layout.with_tasks(rows, post).groupBy("worker_id").agg(*aggs).select(*out)


def total_sums(k: int) -> list[Column]:
    """Aggregates of a parameter table that :func:`read_totals` reads."""
    return [F.sum(c).alias(c) for c in [*(f"tot_g{i}" for i in range(k)), "tot_ev"]]


def read_totals(seen: dict, k: int) -> tuple[list[float], float]:
    """Label shares and log evidence from the observed totals of a round."""
    shares = [float(seen[f"tot_g{i}"]) for i in range(k)]
    n = sum(shares)
    return [s / n for s in shares], float(seen["tot_ev"])


def decode(post: DataFrame, labels: Sequence[int], positive: int | None = None) -> DataFrame:
    """Most probable label (ties to the larger), score of the positive label, full p."""
    k = len(labels)
    candidates = [
        F.struct(F.round(F.col(f"g{i}"), 12).alias("p"), F.lit(int(labels[i])).alias("label")) for i in range(k)
    ]
    best = F.array_max(F.array(*candidates))["label"]
    if positive is None:
        positive = 1 if 1 in labels else labels[-1]
    return post.select(
        "task_id",
        best.alias("label"),
        F.col(f"g{list(labels).index(positive)}").alias("score"),
        F.array(*[F.col(f"g{i}") for i in range(k)]).alias("p"),
    )


def index_labels(ann: DataFrame, labels: Sequence[int], ignore_other_labels: bool = False) -> DataFrame:
    """Replace label values by their position in ``labels``.

    A null label is no label.  Any other value outside ``labels`` is an error unless ``ignore_other_labels``.
    """
    ann = ann.filter(F.col("label").isNotNull())
    pos = F.array_position(F.array(*[F.lit(int(v)) for v in labels]), F.col("label").cast("int")) - 1
    if ignore_other_labels:
        return ann.withColumn("label", pos.cast("int")).filter(F.col("label") >= 0)
    wrong = F.raise_error(F.concat(F.lit(f"label not among {list(labels)}: "), F.col("label").cast("string")))
    return ann.withColumn("label", F.when(pos >= 0, pos.cast("int")).otherwise(wrong))


def fit_em(
    ann: DataFrame,
    model: WorkerModel,
    labels: Sequence[int] | None = None,
    rounds: int = 100,
    threshold: float | None = 1e-4,
    dedupe: str = "distinct",
    learn_prior: bool = True,
    start_posterior: str | None = None,
    gold: DataFrame | None = None,
    ref_params: dict[str, DataFrame] | None = None,
    logging_freq: int | None = None,
    rows_per_part: int = skew.ROWS_PER_PART,
    ignore_other_labels: bool = False,
    resume_dir: str | None = None,
) -> Fit:
    """Alternate E and M steps until the log-likelihood settles.

    ``start_posterior='votes'`` starts from vote shares instead of from the
    model's initial parameters (for models whose start is symmetric).

    ``resume_dir`` is a folder that driver and executors share.  Every round is committed there, and a fit of the
    same annotations and settings goes on after the last committed one; ``rounds`` may be larger than before.
    Rounds of another fit in that folder, or more than ``rounds`` of them, are an error.

    The totals of a round are observed by the job that writes its parameters, so a round has no other job.  Every
    ``logging_freq`` rounds the trace also gets label metrics against ``gold`` and errors against ``ref_params``.
    A table without labels is an error.
    """
    if rounds < 1:
        raise ValueError("rounds must be at least 1")
    spark = ann.sparkSession
    if labels is None:
        labels = infer_labels(ann.filter(F.col("label").isNotNull()))
    ann = canonical(ann, dedupe)
    k = model.k = len(labels)
    if k < 2:
        raise ValueError("label aggregation needs at least two labels")
    scratch = Scratch(spark)
    layout = Layout(index_labels(ann, labels, ignore_other_labels), scratch, rows_per_part)
    like = [model.likelihood(t) for t in range(k)]
    prior = [1.0 / k] * k
    total = rounds + model.warmup
    columns, sums = step_columns(model), total_sums(k)
    monitor = Monitor(scratch, gold, ref_params, logging_freq)
    trace: list[tuple[int, str, float]] = []
    try:
        if layout.rows == 0:
            raise ValueError("no annotations to learn from")
        before = None  # (params, prior) that produced the current posterior
        last_llh = None
        done, log, found = 0, None, None
        if resume_dir:
            settings = {n: v for n, v in vars(model).items() if isinstance(v, int | float | str)}
            fit = identity(layout.ann, model=model.name, labels=list(labels), learn=learn_prior, start=start_posterior, **settings)
            log = Rounds(spark, resume_dir, fit)
            found = log.last()

        def store(t: int, table: DataFrame) -> DataFrame:
            return log.write(t, table) if log else scratch.cut(table, "params")

        if found:
            done, old, params, state = found
            if done > total:
                raise ValueError(f"{resume_dir} holds {done} rounds, more than {total}")
            before, prior, last_llh = (old, state["before"]), state["prior"], state["last_llh"]
            trace = [tuple(entry) for entry in state["trace"]]
        else:
            start = [c.alias(n) for n, c in model.init_columns().items()]
            params = store(0, layout.workers().select("worker_id", *start))
        for t in range(done + 1, total + 2):
            if t == 1 and start_posterior == "votes":
                post = vote_shares(layout, k)
            else:
                post = posterior(layout, params, like, prior)
            if t > total:
                # one evidence pass closes the trace
                llh = float(post.agg(F.sum("evidence")).first()[0])
                trace.append((t - 1 - model.warmup, "log_likelihood", llh))
                break
            new, seen = watched(lambda table, t=t: store(t, table), maximise(layout, params, post, model, columns), sums)
            new_prior, llh = read_totals(seen, k)
            if t > 1:
                trace.append((t - 1 - model.warmup, "log_likelihood", llh))
                if (
                    t > model.warmup + 1
                    and last_llh is not None
                    and relative_change_below(llh, last_llh, threshold)
                ):
                    break
            last_llh = llh if not (t == 1 and start_posterior) else None
            older, before = before, (params, prior)
            params, prior = new, (new_prior if learn_prior else prior)
            if t > model.warmup and monitor.due(t - 1):
                trace += monitor.rows(t - model.warmup, decode(post, labels), model.worker_table(params))
            if log:
                log.commit(t, {"before": before[1], "prior": prior, "last_llh": last_llh, "trace": trace})
            if older is not None:
                scratch.drop(older[0])
        if total == 1 and start_posterior == "votes":
            final = vote_shares(layout, k)
        else:
            final = posterior(layout, before[0], like, before[1])
        post = scratch.cut(final, "posterior")
    finally:
        layout.close()
    return Fit(model.name, decode(post, labels), model.worker_table(params), None, trace, prior)


def vote_shares(layout: Layout, k: int) -> DataFrame:
    """Posterior proportional to the votes of a task."""
    aggs = [F.count("*").alias("n_i")] + [
        F.sum((F.col("label") == i).cast("double")).alias(f"g{i}") for i in range(k)
    ]
    merge = [F.sum("n_i").alias("n_i")] + [F.sum(f"g{i}").alias(f"g{i}") for i in range(k)]
    votes = layout.by_task(layout.ann, aggs, merge)
    return votes.select(
        "task_id",
        *[(F.col(f"g{i}") / F.col("n_i")).alias(f"g{i}") for i in range(k)],
        "n_i",
        F.lit(0.0).alias("evidence"),
    )


@dataclass
class Monitor:
    """What a fit reports in its first round and every ``every`` rounds after it: labels against ``gold``, worker parameters against ``refs``."""

    scratch: Scratch
    gold: DataFrame | None = None
    refs: dict[str, DataFrame] | None = None
    every: int | None = None

    def due(self, round_: int) -> bool:
        return bool(self.every) and round_ % self.every == 0

    def rows(self, step: int, labels: DataFrame, workers: DataFrame) -> list[tuple[int, str, float]]:
        out = [] if self.gold is None else label_metrics(step, labels, self.gold, self.scratch)
        return out + param_metrics(step, workers, self.refs)


def label_metrics(step: int, labels: DataFrame, gold: DataFrame, scratch: Scratch | None = None) -> list[tuple[int, str, float]]:
    """Confusion cells, accuracy, F1 of both classes and AUC of the decoded labels.

    The posterior is computed once: the job that writes the predictions also counts the cells, and AUC ranks the
    written rows.  A score without any case is 0, an AUC without both classes is left out.
    """
    from tallyfold.operators.evaluation import auc, confusion_cells

    scratch = scratch or Scratch(labels.sparkSession)
    pred = labels.join(gold, "task_id").select("task_id", "gold", F.col("label").alias("pred"), "score")
    pred, cells = watched(lambda table: scratch.cut(table, "predictions"), pred, confusion_cells())
    tn, fp, fn, tp = (float(cells[c]) for c in ("tn", "fp", "fn", "tp"))
    area = auc(pred).first()["auc"]
    scratch.drop(pred)
    values = {
        "acc": (tp + tn) / max(1.0, tp + tn + fp + fn),
        "auc": area,
        "posi_f1": 2 * tp / max(1.0, 2 * tp + fp + fn),
        "nega_f1": 2 * tn / max(1.0, 2 * tn + fp + fn),
        "tn": tn, "fp": fp, "fn": fn, "tp": tp,
    }
    return [(step, name, float(v)) for name, v in values.items() if v is not None]


def param_metrics(
    step: int, est: DataFrame, refs: dict[str, DataFrame] | None, key: str = "worker_id"
) -> list[tuple[int, str, float]]:
    """Mean squared error of each parameter that has a reference table ``(key, ref)``."""
    from tallyfold.operators.evaluation import mean_squared_error

    out = []
    for name, ref in (refs or {}).items():
        if name not in est.columns or key not in ref.columns:
            continue
        # a confusion matrix is one row per (worker, truth, label), a distribution one array per worker
        keys = [c for c in (key, "truth", "label") if c in ref.columns and c in est.columns]
        found = est.select(*keys, F.col(name).alias("est"))
        known = ref.select(*keys, "ref")
        if isinstance(found.schema["est"].dataType, T.ArrayType):
            found = found.select(*keys, F.posexplode("est").alias("_at", "est"))
            known = known.select(*keys, F.posexplode("ref").alias("_at", "ref"))
            keys = [*keys, "_at"]
        pairs = known.join(found, keys)
        mse = mean_squared_error(pairs).first()["mse"]
        if mse is not None:
            out.append((step, f"{name}_mse", float(mse)))
    return out
