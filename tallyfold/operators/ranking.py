"""Row numbers and running totals that survive one dominant group.

Rows are range-partitioned on (group, order) into slices, so a hot group spans
many slices.  A row number is the local number plus the rows of its group in
earlier slices.  Only the first group of a slice can have such rows, so the
table of offsets has at most one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfold.session import Scratch, shuffle_partitions

def _slices(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Range-partition by ``order`` and record the slice number, written once."""
    spark = df.sparkSession
    sliced = df.repartitionByRange(shuffle_partitions(spark), *order).withColumn(
        "_slice", F.spark_partition_id()
    )
    return Scratch(spark).cut(sliced, name)


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of two lists of columns."""
    cond = F.lit(True)
    for x, y in zip(left, right):
        cond = cond & F.col(x).eqNullSafe(F.col(y))
    return cond


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rn") -> DataFrame:
    """``row_number()`` within ``keys``; ``order`` must be a total order.  Null keys form a group."""
    keys = list(keys)
    sliced = _slices(df, [F.col(k) for k in keys] + list(order), "rank-slices")
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_slice")
    before = F.sum("_n").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_slice.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_in"), before.alias("_before")
    ).filter("_before > 0")
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    same = _same([*keys, "_slice"], [*[f"_key{i}" for i in range(len(keys))], "_in"])
    return (
        sliced.withColumn("_local", F.row_number().over(local))
        .join(F.broadcast(offsets), same, "left")
        .withColumn(out, (F.col("_local") + F.coalesce("_before", F.lit(0))).cast("long"))
        .select(*df.columns, out)
    )


def running_totals(df: DataFrame, order: str, values: Sequence[str]) -> DataFrame:
    """Add ``<v>_before``: the total of ``v`` over rows with a smaller ``order`` (unique)."""
    sliced = _slices(df, [F.col(order)], "total-slices")
    per_slice = sliced.groupBy("_slice").agg(*[F.sum(v).alias(v) for v in values])
    # one row per slice: as many rows as shuffle partitions
    w = Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        "_slice", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(f"_{v}_off") for v in values]
    )
    local = Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = sliced.join(F.broadcast(offsets), "_slice")
    for v in values:
        out = out.withColumn(
            f"{v}_before", F.coalesce(F.sum(v).over(local), F.lit(0)) + F.col(f"_{v}_off")
        ).drop(f"_{v}_off")
    return out.drop("_slice")


def rerank_runs(runs: DataFrame) -> DataFrame:
    """Ranks 1..n within each (run, topic) by numeric score, best first.

    Ties go to the smaller old rank, then to the smaller document id.
    """
    order = [F.col("score").cast("double").desc(), F.col("rank"), F.col("doc_id")]
    renamed = runs.withColumn("score", F.col("score").cast("double"))
    return (
        row_numbers(renamed, ["run", "topic_id"], order, "new_rank")
        .drop("rank")
        .withColumnRenamed("new_rank", "rank")
    )


def top_fraction(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    fraction: float,
) -> DataFrame:
    """First ``floor(fraction * n)`` rows of each group in ``order``."""
    numbered = Scratch(df.sparkSession).cut(row_numbers(df, keys, order, "_rn"), "numbered")
    # the highest number of a group is its size
    names = [f"_key{i}" for i in range(len(keys))]
    sizes = numbered.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        F.floor(F.lit(float(fraction)) * F.max("_rn")).alias("_keep")
    )
    kept = numbered.join(sizes, _same(keys, names)).filter(F.col("_rn") <= F.col("_keep"))
    return kept.select(*df.columns)


def top_k(df: DataFrame, score: str, k: int, tie: str) -> DataFrame:
    """The ``k`` best rows by score (ties to the smaller ``tie``): a bounded heap per task."""
    return df.orderBy(F.desc(score), F.col(tie)).limit(k)
