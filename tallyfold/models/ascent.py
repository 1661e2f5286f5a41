"""Gradient ascent on parameters of both sides of the annotation graph.

A model has some parameters per task and some per worker and an objective that
is a sum over annotations plus a penalty per task and per worker.  One step is
two aggregates (by worker and by task) of row gradients; the step length is
picked by evaluating the objective at several lengths in one more pass, so the
objective never falls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.models.em import Layout
from tallyfold.session import Scratch

STEP_LENGTHS = (8.0, 4.0, 2.0, 1.0, 0.5, 0.25, 0.125, 0.03125, 0.0)
Params = dict[str, Column]


class PairModel:
    """Objective and gradients as Columns; ``p`` maps parameter names to Columns."""

    worker_init: dict[str, float] = {}
    task_init: dict[str, float] = {}

    def row_value(self, p: Params) -> Column:
        raise NotImplementedError

    def row_gradients(self, p: Params) -> dict[str, Column]:
        raise NotImplementedError

    def row_curvature(self, p: Params) -> dict[str, Column]:
        """Non-negative scale of the second derivative of each parameter; one per row unless a model knows better."""
        return {n: F.lit(1.0) for n in [*self.worker_init, *self.task_init]}

    def penalty(self, name: str, value: Column) -> Column:
        """Log prior of one parameter (constants dropped)."""
        raise NotImplementedError

    def penalty_gradient(self, name: str, value: Column) -> Column:
        raise NotImplementedError


def start(layout: Layout, scratch: Scratch, model: PairModel) -> tuple[DataFrame, DataFrame]:
    workers = layout.workers().select("worker_id", *[F.lit(v).alias(n) for n, v in model.worker_init.items()])
    tasks = layout.ann.select("task_id").distinct().select(
        "task_id", *[F.lit(v).alias(n) for n, v in model.task_init.items()]
    )
    return scratch.cut(workers, "workers"), scratch.cut(tasks, "tasks")


def _joined(layout: Layout, workers: DataFrame, tasks: DataFrame, task_data: DataFrame | None) -> DataFrame:
    per_task = tasks if task_data is None else tasks.join(task_data, "task_id")
    return layout.with_tasks(layout.with_workers(layout.ann, workers), per_task)


def ascend(
    layout: Layout,
    scratch: Scratch,
    model: PairModel,
    workers: DataFrame,
    tasks: DataFrame,
    task_data: DataFrame | None = None,
    steps: int = 3,
    step_size: float | None = None,
    max_change: float = 2.0,
) -> tuple[DataFrame, DataFrame, list[float]]:
    """``steps`` ascent steps; returns new tables and the objective after each.

    With ``step_size`` every step has that fixed length and no objective is
    computed.  Gradients are scaled by ``1 / (1 + n)`` of their task or worker,
    which brings very busy and very idle workers to one step length.
    """
    names_w, names_t = list(model.worker_init), list(model.task_init)
    here = {n: F.col(n) for n in names_w + names_t}
    values: list[float] = []

    def step_column(name: str) -> Column:
        g = F.col(f"d_{name}") + model.penalty_gradient(name, F.col(name))
        raw = g / (F.col("n") + 1)
        return F.greatest(F.least(raw, F.lit(max_change)), F.lit(-max_change)).alias(f"step_{name}")

    for _ in range(steps):
        rows = _joined(layout, workers, tasks, task_data)
        grads = model.row_gradients(here)
        by_worker = rows.groupBy("worker_id").agg(
            F.count("*").alias("n"),
            *[F.any_value(n).alias(n) for n in names_w],
            *[F.sum(grads[n]).alias(f"d_{n}") for n in names_w],
        )
        moved_w = scratch.cut(by_worker.select("worker_id", *names_w, *[step_column(n) for n in names_w]), "step-w")
        by_task = layout.by_task(
            rows,
            [
                F.count("*").alias("n"),
                *[F.any_value(n).alias(n) for n in names_t],
                *[F.sum(grads[n]).alias(f"d_{n}") for n in names_t],
            ],
            [
                F.sum("n").alias("n"),
                *[F.any_value(n).alias(n) for n in names_t],
                *[F.sum(f"d_{n}").alias(f"d_{n}") for n in names_t],
            ],
        )
        moved_t = scratch.cut(by_task.select("task_id", *names_t, *[step_column(n) for n in names_t]), "step-t")
        if step_size is None:
            eta, value = _line_search(layout, model, moved_w, moved_t, task_data)
            values.append(value)
        else:
            eta = step_size
        workers = moved_w.select(
            "worker_id", *[(F.col(n) + F.lit(eta) * F.col(f"step_{n}")).alias(n) for n in names_w]
        )
        tasks = moved_t.select(
            "task_id", *[(F.col(n) + F.lit(eta) * F.col(f"step_{n}")).alias(n) for n in names_t]
        )
        if eta == 0.0:
            break
    return workers, tasks, values


def _line_search(
    layout: Layout, model: PairModel, moved_w: DataFrame, moved_t: DataFrame, task_data: DataFrame | None
) -> tuple[float, float]:
    names_w, names_t = list(model.worker_init), list(model.task_init)

    def at(eta: float, names: Sequence[str]) -> Params:
        return {n: F.col(n) + F.lit(eta) * F.col(f"step_{n}") for n in names}

    rows = _joined(layout, moved_w, moved_t, task_data)
    data_part = rows.agg(*[F.sum(model.row_value(at(e, names_w + names_t))) for e in STEP_LENGTHS]).first()

    def penalties(table: DataFrame, names: Sequence[str]) -> Sequence[float]:
        exprs = []
        for e in STEP_LENGTHS:
            p = at(e, names)
            total = F.lit(0.0)
            for n in names:
                total = total + model.penalty(n, p[n])
            exprs.append(F.sum(total))
        return table.agg(*exprs).first()

    pen_w, pen_t = penalties(moved_w, names_w), penalties(moved_t, names_t)
    scores = [
        (float(d) + float(a) + float(b)) if None not in (d, a, b) else float("-inf")
        for d, a, b in zip(data_part, pen_w, pen_t)
    ]
    best = max(range(len(scores)), key=lambda i: (scores[i], -STEP_LENGTHS[i]))
    return STEP_LENGTHS[best], scores[best]


def objective(
    layout: Layout, model: PairModel, workers: DataFrame, tasks: DataFrame, task_data: DataFrame | None = None
) -> float:
    """Data term plus penalties at the given parameters."""
    here = {n: F.col(n) for n in list(model.worker_init) + list(model.task_init)}
    value = _joined(layout, workers, tasks, task_data).agg(F.sum(model.row_value(here))).first()[0]
    for table, names in ((workers, model.worker_init), (tasks, model.task_init)):
        total = F.lit(0.0)
        for n in names:
            total = total + model.penalty(n, F.col(n))
        value += table.agg(F.sum(total)).first()[0]
    return float(value)
