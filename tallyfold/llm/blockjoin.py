"""Exact nearest neighbours by a block matrix join.

1. Equal vectors form a class.  Ties go to the smaller id, so of a class only its ``k + 1`` smallest ids can be
   among anyone's ``k`` nearest; Spark drops the others before the shuffle, so a large group of copies stays small.
2. Queries are dealt into panels of about ``panel`` rows, candidates into columns of tiles.  A candidate goes once
   to every panel, a query once to every column; a task reads the panel of a tile, then streams the candidates
   against it in blocks, so it holds one panel, one block and the best rows so far.
3. A tile is one product of int8 codes.  Each vector x is coded as s * X with s = max|x| / 127, and the lengths of
   x, s * X and x - s * X bound the error of every product: |q.c - s_q s_c Q.C| <= |q - s_q Q||c| + |s_q Q||c - s_c C|.
   Pairs whose upper bound reaches the k-th best lower bound so far are computed again in double precision, term by
   term in the order of the components, and merged into the best ``k`` of the query.
4. The best rows of the tiles of a query are merged by a window of which each task keeps ``k`` rows before the shuffle.

Every row is a vector of its own, also one that repeats an id: it meets all other rows.  Vectors that are null, zero
or hold null or non-finite components take no part; a query meets only vectors of its own length.  Ties go to the
smaller id, then to the earlier row; a null id comes first.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.llm.rows import column
from tallyfold.session import Scratch, shuffle_partitions

BLOCK = 2048
PAIRS = 1 << 17
DIGITS = 1024  # 127 * 127 * DIGITS < 2 ** 24: such sums of products are exact in float32


def usable(vec: Column) -> Column:
    """Not null, not empty, all components finite, one of them not zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vec, lambda x: x != 0.0), F.lit(False))


class Coded:
    """Vectors with their int8 codes and the lengths that bound the error of a product."""

    def __init__(self, row: np.ndarray, ids: list, vec: np.ndarray):
        self.row, self.ids, self.vec = row, ids, vec
        # scaled by the largest component first, so that no square overflows
        top = np.abs(vec).max(1)
        self.scale = top / 127.0
        # a component far below the largest one loses nothing that the bound below does not count
        self.code = np.rint(vec / top[:, None] * 127.0).astype(np.int8)
        near = self.code * self.scale[:, None]
        self.norm, self.near_norm, self.gap = (_length(x) for x in (vec, near, vec - near))


def _length(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1)
    safe = np.where(top > 0, top, 1.0)
    # a little more than the rounded length
    return np.sqrt(((x / safe[:, None]) ** 2).sum(1)) * safe * (1 + 1e-9)


def tile(q: Coded, c: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the codes, scaled, and how far they may be from the true ones."""
    dim = q.code.shape[1]
    total = np.zeros((len(q.row), len(c.row)))
    for a in range(0, dim, DIGITS):
        total += q.code[:, a : a + DIGITS].astype(np.float32) @ c.code[:, a : a + DIGITS].astype(np.float32).T
    with np.errstate(over="ignore", invalid="ignore"):
        total *= q.scale[:, None] * c.scale
        error = q.gap[:, None] * c.norm + q.near_norm[:, None] * c.gap
        # rounding of the double sums, and of the products above
        error += (dim + 8) * 2.3e-16 * q.norm[:, None] * c.norm
    return total, error


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, added from the first component to the last."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * c[:, j]
    return out


class Best:
    """The ``k`` best rows found so far of every query of a panel."""

    def __init__(self, q: Coded, k: int):
        self.q, self.k = q, k
        self.by_row = np.argsort(q.row, kind="stable")
        self.floor = np.full(len(q.row), -np.inf)
        self.who = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.id = np.zeros(0, np.int64)
        self.row = np.zeros(0, np.int64)

    def meet(self, c: Coded) -> None:
        q = self.q
        near, error = tile(q, c)
        low, high = near - error, near + error
        unsure = ~np.isfinite(low) | ~np.isfinite(high)
        low[unsure], high[unsure] = -np.inf, np.inf
        # a row does not meet itself
        at = np.searchsorted(q.row[self.by_row], c.row)
        same = self.by_row[np.minimum(at, len(q.row) - 1)]
        own = np.flatnonzero(q.row[same] == c.row)
        low[same[own], own] = high[same[own], own] = -np.inf
        if len(c.row) >= self.k:
            kth = np.partition(low, len(c.row) - self.k, axis=1)[:, len(c.row) - self.k]
            self.floor = np.maximum(self.floor, kth)
        hit = high >= self.floor[:, None]
        hit[same[own], own] = False
        who, what = np.nonzero(hit)
        for a in range(0, len(who), PAIRS):
            i, j = who[a : a + PAIRS], what[a : a + PAIRS]
            self.merge(i, exact(q.vec[i], c.vec[j]), c.ids[j], c.row[j])

    def merge(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        who = np.concatenate([self.who, who])
        score = np.concatenate([self.score, score])
        ids, row = np.concatenate([self.id, ids]), np.concatenate([self.row, row])
        order = np.lexsort((row, ids, -score, who))
        start = np.searchsorted(who[order], who[order], "left")
        order = order[np.arange(len(order)) - start < self.k]
        self.who, self.score, self.id, self.row = who[order], score[order], ids[order], row[order]
        count = np.bincount(self.who, minlength=len(self.floor))
        full = np.flatnonzero(count == self.k)
        last = np.cumsum(count)[full] - 1
        self.floor[full] = np.maximum(self.floor[full], self.score[last])


NULL_ID = np.iinfo(np.int64).min


def _vectors(part: pa.RecordBatch) -> Coded:
    vec = part.column("v")
    flat = vec.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ids = part.column("id").fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
    return Coded(part.column("r").to_numpy(zero_copy_only=False), ids, flat.reshape(part.num_rows, -1))


def _joined(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, panel, best = None, [], None

        def found():
            q = best.q
            yield pa.RecordBatch.from_arrays(
                [pa.array(q.row[best.who]), pa.array(q.ids[best.who]), pa.array(best.id), pa.array(best.row), pa.array(best.score)],
                names=["q", "query_id", "vec_id", "r", "score"],
            )

        for batch in batches:
            key, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "side"))
            edges = np.flatnonzero((key[1:] != key[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if key[a] != now:
                    if best is not None:
                        yield from found()
                    now, panel, best = key[a], [], None
                if side[a] == 0:
                    panel.append(batch.slice(a, b - a))
                    continue
                if best is None:
                    if not panel:
                        continue
                    best = Best(_vectors(pa.Table.from_batches(panel).combine_chunks().to_batches()[0]), k)
                    panel = []
                for s in range(a, b, BLOCK):
                    best.meet(_vectors(batch.slice(s, min(BLOCK, b - s))))
        if best is not None:
            yield from found()

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    panel: int = 4096,
    columns: int | None = None,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product with each query row.

    ``is_query`` is a condition on the columns of ``vectors``.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    vec = column(vec_col).cast("array<double>")
    numbered = vectors.select(
        column(id_col).cast("long").alias("id"), column(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("ask"), usable(vec).alias("ok")
    ).filter("ok").drop("ok")
    # written once: a row keeps its number
    rows = scratch.cut(numbered.withColumn("r", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    sizes = rows.filter("ask").groupBy("dim").count().collect()  # one row per vector length that occurs in queries
    parts = shuffle_partitions(spark)
    grid, base = [], 0
    for s in sorted(sizes, key=lambda s: s["dim"]):
        panels = max(1, -(-s["count"] // panel))
        across = columns or max(1, -(-parts // panels))
        grid.append((s["dim"], panels, across, base))
        base += panels * across
    out = "query_id long, rank int, vec_id long, score double"
    if not grid:
        return spark.createDataFrame([], out)
    # one row per vector length
    plan = F.broadcast(spark.createDataFrame(grid, "dim int, panels int, across int, base int"))
    in_class = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_first(), "r")
    fewest = rows.withColumn("_n", F.row_number().over(in_class)).filter(F.col("_n") <= k + 1)

    def place(panel_no: Column, col_no: Column) -> Column:
        return (F.col("base") + panel_no * F.col("across") + col_no).cast("int").alias("tile")

    def steps(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    mine = F.pmod(F.xxhash64("r"), F.col("panels"))
    ask = rows.filter("ask").join(plan, "dim").withColumn("c", steps("across"))
    ask = ask.select(place(mine, F.col("c")), F.lit(0).alias("side"), "r", "id", "v")
    all_ = fewest.join(plan, "dim").withColumn("p", steps("panels"))
    all_ = all_.select(place(F.col("p"), F.pmod(F.xxhash64(F.col("r"), F.lit(1)), F.col("across"))), F.lit(1).alias("side"), "r", "id", "v")
    tiles = ask.unionByName(all_).repartitionById(base, "tile").sortWithinPartitions("tile", "side")
    best = tiles.mapInArrow(_joined(k), "q long, query_id long, vec_id long, r long, score double")
    ranked = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "r")
    best = best.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)

    def back(name: str) -> Column:
        return F.when(F.col(name) != int(NULL_ID), F.col(name)).alias(name)

    return best.select(back("query_id"), "rank", back("vec_id"), "score")
