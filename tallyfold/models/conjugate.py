"""Preconditioned nonlinear conjugate gradients on parameters of both sides of the annotation graph.

The unknowns are the columns of two tables, one row per worker and one per task.  One step is one pass over the
annotations joined with both tables: for every length of a short ladder the row values and row gradients are summed by
task and by worker, so choosing the length also yields the gradient there and no pass is spent on a line search alone.
Gradients are divided by the diagonal curvature of their worker or task at the start of the climb.  Directions follow
Polak and Ribiere, restarted when their factor is negative or when no length of the ladder helps.

Expressions over annotation rows are built once and read the points from columns, so each pass runs the same
generated code.  What reaches the driver are a few sums per step; the tables themselves stay in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.models.ascent import PairModel
from tallyfold.models.em import Layout
from tallyfold.session import Scratch, watched

LADDER = (2.0, 1.0, 0.4)


@dataclass
class Step:
    """Scalars of one accepted point."""

    objective: float
    gradient_norm: float  # largest component
    length: float
    momentum: float  # Polak-Ribiere factor of the direction that follows


def _add(parts: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + p
    return total


class _Side:
    """One of the two tables: its key, its unknowns and the expressions over its rows, for ``n_points`` points."""

    def __init__(self, model: PairModel, key: str, names: Sequence[str], n_points: int):
        self.key, self.names, self.points = key, list(names), range(n_points)
        self.finish = []
        for c in self.points:
            p = {v: F.col(f"{v}__{c}") for v in self.names}
            self.finish += [(F.col(f"s{c}_{v}") + model.penalty_gradient(v, p[v])).alias(f"g{c}_{v}") for v in self.names]
            self.finish.append(_add([model.penalty(v, p[v]) for v in self.names]).alias(f"pen{c}"))
        text = []
        for c in self.points:
            own = " + ".join(f"g{c}_{v} * g{c}_{v} / h_{v}" for v in self.names) or "0D"
            cross = " + ".join(f"g{c}_{v} * g_{v} / h_{v}" for v in self.names) or "0D"
            top = ", ".join(["0D", "0D", *[f"abs(g{c}_{v})" for v in self.names]])
            text += [f"sum(v{c}) AS value{c}", f"sum(pen{c}) AS pen{c}", f"max(greatest({top})) AS top{c}", f"sum({own}) AS own{c}", f"sum({cross}) AS cross{c}"]
        self.scalars = [F.expr(x) for x in text]
        self.kept = [key, *self.names, *[f"{x}_{v}" for x in "dgh" for v in self.names]]

    def spread(self, table: DataFrame, lengths: Sequence[float]) -> DataFrame:
        """The table with its unknowns at every point."""
        return table.selectExpr("*", *[f"{v} + {float(x)!r}D * d_{v} AS {v}__{c}" for c, x in enumerate(lengths) for v in self.names])

    def for_rows(self, table: DataFrame) -> DataFrame:
        return table.selectExpr(self.key, *[f"{v}__{c}" for c in self.points for v in self.names])

    def moved(self, table: DataFrame, c: int, length: float, momentum: float) -> DataFrame:
        """The table at point ``c`` with the gradient there and the next direction."""
        return table.selectExpr(
            self.key, *[f"{v} + {float(length)!r}D * d_{v} AS {v}" for v in self.names], *[f"g{c}_{v} AS g_{v}" for v in self.names],
            *[f"g{c}_{v} / h_{v} + {float(momentum)!r}D * d_{v} AS d_{v}" for v in self.names], *[f"h_{v}" for v in self.names],
        )

    def written(self, table: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[dict[str, float]]]:
        """The written table and the sums of each point, observed by the job that writes it."""
        out, seen = watched(lambda x: scratch.cut(x, "points"), table, self.scalars)
        return out, [{k: float(seen[f"{k}{c}"] or 0.0) for k in ("value", "pen", "top", "own", "cross")} for c in self.points]


class _Pass:
    """The joined pass for a number of points."""

    def __init__(self, layout: Layout, model: PairModel, n_points: int, curvature: bool = False):
        self.layout, names = layout, [*model.worker_init, *model.task_init]
        self.workers = _Side(model, "worker_id", model.worker_init, n_points)
        self.tasks = _Side(model, "task_id", model.task_init, n_points)
        points = [{v: F.col(f"{v}__{c}") for v in names} for c in range(n_points)]
        grads = [model.row_gradients(p) for p in points]
        curve = model.row_curvature(points[0]) if curvature else {}

        def sums(side: _Side) -> list[Column]:
            out = [F.sum(g[v]).alias(f"s{c}_{v}") for c, g in enumerate(grads) for v in side.names]
            return out + [F.sum(curve[v]).alias(f"c_{v}") for v in side.names if curvature]

        self.by_worker, self.by_task = sums(self.workers), sums(self.tasks)
        self.by_task += [F.sum(model.row_value(p)).alias(f"v{c}") for c, p in enumerate(points)]
        summed = [f"s{c}_{v}" for c in range(n_points) for v in self.tasks.names] + [f"c_{v}" for v in self.tasks.names if curvature]
        self.merge = [F.sum(n).alias(n) for n in [*summed, *[f"v{c}" for c in range(n_points)]]]
        self.curvature = curvature

    def run(self, rows: DataFrame, workers: DataFrame, tasks: DataFrame, lengths: Sequence[float], scratch: Scratch):
        """Both tables with gradients and penalties at every point, and the sums of each point."""
        w, t = self.workers.spread(workers, lengths), self.tasks.spread(tasks, lengths)
        both = self.layout.with_tasks(self.layout.with_workers(rows, self.workers.for_rows(w)), self.tasks.for_rows(t))
        new_w = both.groupBy("worker_id").agg(*self.by_worker)
        new_t = self.layout.by_task(both, self.by_task, self.merge)
        zero = [F.lit(0.0).alias(f"v{c}") for c in self.workers.points]
        w = self._finish(self.workers, w.join(new_w, "worker_id"), zero)
        t = self._finish(self.tasks, t.join(new_t, "task_id"), [F.col(f"v{c}") for c in self.tasks.points])
        (w, of_workers), (t, of_tasks) = self.workers.written(w, scratch), self.tasks.written(t, scratch)
        joined = [
            {k: max(a[k], b[k]) if k == "top" else a[k] + b[k] for k in a} for a, b in zip(of_workers, of_tasks)
        ]
        return w, t, joined

    def _finish(self, side: _Side, full: DataFrame, values: Sequence[Column]) -> DataFrame:
        if self.curvature:
            full = full.drop(*[f"h_{v}" for v in side.names]).selectExpr("*", *[f"c_{v} + 1D AS h_{v}" for v in side.names])
        return full.select(*side.kept, *values, *side.finish)


def climb(
    layout: Layout,
    scratch: Scratch,
    model: PairModel,
    workers: DataFrame,
    tasks: DataFrame,
    task_data: DataFrame | None = None,
    steps: int = 25,
    tolerance: float = 0.01,
    step_size: float | None = None,
) -> tuple[DataFrame, DataFrame, list[Step]]:
    """At most ``steps`` steps, or until no gradient component exceeds ``tolerance``.

    With ``step_size`` every step has that length.  Returns the new tables and the scalars of every point, the
    start included.
    """
    rows = layout.ann if task_data is None else layout.with_tasks(layout.ann, task_data)
    rows = rows.persist()

    def still(table: DataFrame, side: _Side) -> DataFrame:
        return table.selectExpr(side.key, *side.names, *[f"0D AS {x}_{v}" for x in "dgh" for v in side.names])

    try:
        first = _Pass(layout, model, 1, curvature=True)
        w, t, scores = first.run(rows, still(workers, first.workers), still(tasks, first.tasks), [0.0], scratch)
        here = scores[0]
        value = here["value"] + here["pen"]
        trace = [Step(value, here["top"], 0.0, 0.0)]
        c, length, momentum, scale = 0, 0.0, 0.0, 1.0
        ladder = _Pass(layout, model, len(LADDER) if step_size is None else 1)
        while len(trace) <= steps and trace[-1].gradient_norm > tolerance:
            lengths = [step_size] if step_size is not None else [x * scale for x in LADDER]
            new_w, new_t, scores = ladder.run(
                rows, ladder.workers.moved(w, c, length, momentum), ladder.tasks.moved(t, c, length, momentum), lengths, scratch
            )
            totals = [s["value"] + s["pen"] for s in scores]
            best = max(range(len(totals)), key=lambda i: (totals[i], -lengths[i]))
            if step_size is None and not totals[best] > value:
                scratch.drop(new_w)
                scratch.drop(new_t)
                if momentum == 0.0 and scale < 1e-4:
                    break
                # a fresh start along the gradient, then with shorter steps
                momentum, scale = 0.0, scale if momentum else scale / 8
                continue
            momentum = max(0.0, (scores[best]["own"] - scores[best]["cross"]) / here["own"]) if here["own"] > 0 else 0.0
            scratch.drop(w)
            scratch.drop(t)
            w, t, value, here, c, length = new_w, new_t, totals[best], scores[best], best, lengths[best]
            scale = min(1.0, max(1e-4, length)) if step_size is None else 1.0
            trace.append(Step(value, here["top"], length, momentum))
        out_w = scratch.cut(ladder.workers.moved(w, c, length, 0.0).select("worker_id", *ladder.workers.names), "workers")
        out_t = scratch.cut(ladder.tasks.moved(t, c, length, 0.0).select("task_id", *ladder.tasks.names), "tasks")
        scratch.drop(w)
        scratch.drop(t)
    finally:
        rows.unpersist()
    return out_w, out_t, trace
