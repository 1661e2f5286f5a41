"""Several starts of the spammer model in the passes of one fit.

The parameters of all starts lie side by side in one row per worker (``spamming_r``, ``copying_r``,
``strategy_r``), so a round reads the annotations once and shuffles one map-side combined row per worker,
however many starts there are.  The driver sees one log-likelihood per start and round; the start with the
largest one after the last round wins (ties, to six places, go to the first).

Start 0 begins with vote shares, as a single fit does.  Start r > 0 begins with parameters moved by the MD5
hash of ``seed:r:worker_id:j``: spamming 0.5 + noise * (u - 0.5), strategies in proportion to 1 + noise * u.
The same seed therefore gives the same fit on every cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.mathx import digamma
from tallyfold.models.em import (
    Fit,
    Layout,
    WorkerModel,
    decode,
    index_labels,
    infer_labels,
    posterior,
    relative_change_below,
    vote_shares,
)
from tallyfold.operators.annotations import canonical
from tallyfold.operators.skew import ROWS_PER_PART
from tallyfold.session import Scratch

PARAMS = ("spamming", "copying", "strategy")


def start_table(workers: DataFrame, k: int, restarts: int, noise: float, seed: int) -> DataFrame:
    """``worker_id`` and the first parameters of every start."""

    def u(r: int, j: int) -> str:
        key = f"concat('{seed}:{r}:', CAST(worker_id AS STRING), ':{j}')"
        return f"CAST(conv(substring(md5({key}), 1, 8), 16, 10) AS DOUBLE) / 4294967296D"

    cells = ["worker_id", "0.5D AS s_0", f"array({', '.join([f'{1.0 / k!r}D'] * k)}) AS x_0"]
    for r in range(1, restarts):
        cells.append(f"0.5D + {float(noise)!r}D * ({u(r, 0)} - 0.5D) AS s_{r}")
        cells.append(f"array({', '.join(f'1D + {float(noise)!r}D * {u(r, y + 1)}' for y in range(k))}) AS x_{r}")
    out = ["worker_id"]
    for r in range(restarts):
        total = f"aggregate(x_{r}, 0D, (a, v) -> a + v)"
        out += [f"s_{r} AS spamming_{r}", f"1D - s_{r} AS copying_{r}", f"transform(x_{r}, v -> v / {total}) AS strategy_{r}"]
    return workers.selectExpr(*cells).selectExpr(*out)


def one_start(params: DataFrame, r: int) -> DataFrame:
    """The parameters of one start under their plain names."""
    return params.select("worker_id", *[F.col(f"{p}_{r}").alias(p) for p in PARAMS])


def e_step(layout: Layout, params: DataFrame, k: int, restarts: int, votes: bool) -> DataFrame:
    """``(task_id, n_i, g{r}_{truth}, ev{r})`` of every start; start 0 takes vote shares if ``votes``."""
    starts = range(1 if votes else 0, restarts)
    each = range(k)
    rows = layout.with_workers(layout.ann, params)
    cells = [*layout.keys, *[f"CAST(label = {i} AS DOUBLE) AS v{i}" for i in each if votes]]
    for r in starts:
        spam = f"spamming_{r} * strategy_{r}[label]"
        cells += [f"CASE WHEN label = {i} THEN copying_{r} ELSE 0D END + {spam} AS l{r}_{i}" for i in each]
    aggs, merge = ["count(*) AS n_i"], ["sum(n_i) AS n_i"]
    names = [f"v{i}" for i in each if votes]
    aggs += [f"sum({n}) AS {n}" for n in names]
    for r in starts:
        for i in each:
            aggs += [
                f"sum(CASE WHEN l{r}_{i} > 0 THEN ln(l{r}_{i}) END) AS s{r}_{i}",
                f"sum(CAST(l{r}_{i} <= 0 AS BIGINT)) AS z{r}_{i}",
            ]
            names += [f"s{r}_{i}", f"z{r}_{i}"]
    merge += [f"sum({n}) AS {n}" for n in names]
    sums = layout.by_task(rows.selectExpr(*cells), [F.expr(a) for a in aggs], [F.expr(m) for m in merge])
    prior = f"{math.log(k)!r}D"
    shares = [f"v{i} / n_i AS g0_{i}" for i in each if votes] + (["0D AS ev0"] if votes else [])
    keep = ["task_id", "n_i", *[s.rsplit(" ", 1)[1] for s in shares]]
    weights = [f"CASE WHEN z{r}_{i} = 0 THEN coalesce(s{r}_{i}, 0D) - {prior} END AS w{r}_{i}" for r in starts for i in each]
    out = sums.selectExpr("task_id", "n_i", *shares, *weights)
    top = [f"greatest({', '.join(f'w{r}_{i}' for i in each)}) AS m{r}" for r in starts]
    out = out.selectExpr("*", *top)
    out = out.selectExpr(
        *keep, *[f"m{r}" for r in starts], *[f"coalesce(exp(w{r}_{i} - m{r}), 0D) AS e{r}_{i}" for r in starts for i in each]
    )
    final = []
    for r in starts:
        total = f"({' + '.join(f'e{r}_{i}' for i in each)})"
        final += [f"CASE WHEN m{r} IS NULL THEN {1.0 / k!r}D ELSE e{r}_{i} / {total} END AS g{r}_{i}" for i in each]
        final.append(f"CASE WHEN m{r} IS NULL THEN 0D ELSE m{r} + ln({total}) END AS ev{r}")
    return out.selectExpr(*keep, *final)


def m_step(layout: Layout, params: DataFrame, post: DataFrame, model: WorkerModel, restarts: int) -> DataFrame:
    """New parameters of every start and each worker's share of their log-likelihoods (``tot_ev{r}``)."""
    k, each = model.k, range(restarts)
    rows = layout.with_tasks(layout.with_workers(layout.ann, params), post)
    mass = ["worker_id", "label", *[f"ev{r} / n_i AS ev{r}" for r in each]]
    for r in each:
        own = f"CASE label {' '.join(f'WHEN {i} THEN g{r}_{i}' for i in range(k))} END"
        spam = f"spamming_{r} * strategy_{r}[label]"
        mass.append(f"({own}) * coalesce(try_divide({spam}, copying_{r} + {spam}), 1D) + (1D - ({own})) AS mass{r}")
    aggs = [F.count("*").cast("double").alias("n")]
    for r in each:
        aggs += [F.expr(f"sum(mass{r}) AS spam{r}"), F.expr(f"sum(ev{r}) AS tot_ev{r}")]
        aggs += [F.expr(f"sum(CASE WHEN label = {y} THEN mass{r} ELSE 0D END) AS spam{r}_{y}") for y in range(k)]
    sums = rows.selectExpr(*mass).groupBy("worker_id").agg(*aggs)
    a, b, d = float(model.alpha), float(model.beta), float(model.delta)

    def ratio(x, total):
        return F.exp(digamma(x) - digamma(total)) if model.variational else x / total

    out = [F.col("worker_id")]
    for r in each:
        n, spam = F.col("n"), F.col(f"spam{r}")
        out += [
            ratio(spam + a, n + (a + b)).alias(f"spamming_{r}"),
            ratio(n - spam + b, n + (a + b)).alias(f"copying_{r}"),
            F.array(*[ratio(F.col(f"spam{r}_{y}") + d, spam + d * k) for y in range(k)]).alias(f"strategy_{r}"),
            F.col(f"tot_ev{r}"),
        ]
    return sums.select(*out)


def best_start(values: Sequence[float]) -> int:
    """Largest log-likelihood; ties to six places go to the first."""
    return max(range(len(values)), key=lambda r: (round(values[r], 6), -r))


def fit_restarts(
    ann: DataFrame,
    model: WorkerModel,
    restarts: int,
    rounds: int = 100,
    threshold: float | None = None,
    noise: float = 0.5,
    seed: int = 0,
    labels: Sequence[int] | None = None,
    dedupe: str = "max",
    rows_per_part: int = ROWS_PER_PART,
    ignore_other_labels: bool = False,
) -> Fit:
    """Fit of the best start.

    The trace holds ``log_likelihood_r`` of every start and round and, at the end, ``chosen_start``.  With a
    ``threshold`` the rounds end when the relative change of every start is below it.  An empty table of
    annotations needs ``labels`` and gives empty tables.
    """
    if rounds < 1 or restarts < 1:
        raise ValueError("rounds and restarts must be at least 1")
    if not 0 <= noise < 1:
        raise ValueError("noise must be in [0, 1)")
    if labels is None:
        labels = infer_labels(ann.filter(F.col("label").isNotNull()))
    k = model.k = len(labels)
    if k < 2:
        raise ValueError("label aggregation needs at least two labels")
    scratch = Scratch(ann.sparkSession)
    layout = Layout(index_labels(canonical(ann, dedupe), labels, ignore_other_labels), scratch, rows_per_part)
    each = range(restarts)
    trace: list[tuple[int, str, float]] = []
    try:
        params = scratch.cut(start_table(layout.workers(), k, restarts, noise, seed), "params")
        before, last = None, None
        for t in range(1, rounds + 2):
            post = e_step(layout, params, k, restarts, votes=t == 1)
            if t > rounds:
                row = post.agg(*[F.sum(f"ev{r}") for r in each]).first()
            else:
                new = scratch.cut(m_step(layout, params, post, model, restarts), "params")
                row = new.agg(*[F.sum(f"tot_ev{r}") for r in each]).first()
            now = [float(v or 0.0) for v in row]
            if t > 1:
                trace += [(t - 1, f"log_likelihood_{r}", now[r]) for r in each]
                # the vote shares of round 1 have no likelihood, so start 0 is compared from round 3 on
                if t > rounds or (t > 2 and all(relative_change_below(a, b, threshold) for a, b in zip(now, last))):
                    break
            last = now
            if before is not None:
                scratch.drop(before)
            before, params = params, new
        best = best_start(now)
        trace.append((t - 1, "chosen_start", float(best)))
        if t == 2 and best == 0:
            final = vote_shares(layout, k)
        else:
            final = posterior(layout, one_start(before, best), [model.likelihood(i) for i in range(k)], [1.0 / k] * k)
        post = scratch.cut(final, "posterior")
    finally:
        layout.close()
    return Fit(model.name, decode(post, labels), model.worker_table(one_start(params, best)), None, trace, [1.0 / k] * k)
