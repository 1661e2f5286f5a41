"""Bounded training samples, and fits that run in one Arrow task.

A sample keeps the rows whose hash falls below limit / rows, so its size is bounded in expectation by the
documented ``limit`` and it is the same on every run; repeated ids are reduced to one row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def below(key: Column, share: float, salt: int) -> Column:
    """True for about ``share`` of the values of key."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def fit_once(sample: DataFrame, fn: Callable[[pa.Table], object]) -> object:
    """``fn`` of the whole bounded sample, computed in one task; its result travels pickled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        out = pickle.dumps(fn(pa.Table.from_batches(got)) if got else None)
        yield pa.RecordBatch.from_arrays([pa.array([out], pa.large_binary())], names=["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows and rows[0]["model"] is not None else None


def sparse(table: pa.Table, idx: str, val: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, index and value of all entries of two list columns."""
    lists = table.column(idx).combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = table.column(val).combine_chunks().flatten()
    return row, lists.flatten().to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False)


def as_lists(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Distinct (text, key) pairs with their counts as two list columns; ``key`` below 2**32."""
    pair, count = np.unique(doc.astype(np.int64) << 32 | key.astype(np.int64), return_counts=True)
    off = pa.array(np.searchsorted(pair >> 32, np.arange(n + 1)).astype(np.int32))
    idx = pa.array((pair & 0xFFFFFFFF).astype(np.int32))
    return pa.ListArray.from_arrays(off, idx), pa.ListArray.from_arrays(off, pa.array(count.astype(np.float32)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 12) -> np.ndarray:
    """Weights (last one: intercept) of a ridge-penalised logistic regression, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], l2)
    pen[-1] = 1e-6

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * pen @ (w * w)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (p - y) + pen * w
        hess = (x * (p * (1 - p))[:, None].astype(x.dtype)).T @ x + np.diag(pen)
        step = np.linalg.solve(hess, grad)
        scale = 1.0
        while (new := loss(w - scale * step)) > now and scale > 1e-4:
            scale /= 2
        w = w - scale * step
        if now - new < 1e-4 * max(1.0, now):
            break
        now = new
    return w
