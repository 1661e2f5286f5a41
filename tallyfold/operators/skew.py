"""Splitting of hot keys.

A key that owns a large share of the rows is cut into ``part`` numbers by a
hash of another column; the other side of the join is repeated once per part.
A hot key has more than ``rows_per_part`` rows, so the list holds at most
rows / rows_per_part keys; Spark broadcasts it only below its own threshold.
Keys match null-safely, so rows with a null key stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_PART = 2_000_000


def hot_keys(df: DataFrame, key: str, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """``(key, parts)`` for keys above ``rows_per_part`` rows."""
    return hot_from_counts(df.groupBy(key).count(), key, "count", rows_per_part)


def hot_from_counts(
    counts: DataFrame, key: str, count: str, rows_per_part: int = ROWS_PER_PART
) -> DataFrame:
    """The same list from a table that already holds the row count of each key."""
    return counts.filter(F.col(count) > rows_per_part).select(
        key, F.ceil(F.col(count) / rows_per_part).cast("int").alias("parts")
    )


def _with_parts(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    listed = hot.select(F.col(key).alias("_hot_key"), "parts")
    return df.join(listed, df[key].eqNullSafe(F.col("_hot_key")), "left").drop("_hot_key")


def spread(df: DataFrame, key: str, by: str, hot: DataFrame, part: str) -> DataFrame:
    """Add the part number of each row of the big side."""
    return (
        _with_parts(df, key, hot)
        .withColumn(part, F.coalesce(F.pmod(F.hash(by), F.col("parts")), F.lit(0)))
        .drop("parts")
    )


def repeat(df: DataFrame, key: str, hot: DataFrame, part: str) -> DataFrame:
    """Repeat each row of the one-row-per-key side once per part."""
    return (
        _with_parts(df, key, hot)
        .withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
        .drop("parts")
    )


def skew_safe_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    by: str,
    how: str = "inner",
    rows_per_part: int = ROWS_PER_PART,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``big JOIN small ON key`` where ``small`` has one row per key and ``big`` may be hot."""
    if hot is None:
        hot = hot_keys(big, key, rows_per_part)
    left = spread(big, key, by, hot, "_part")
    right = repeat(small, key, hot, "_part")
    right = right.withColumnRenamed(key, "_right_key").withColumnRenamed("_part", "_right_part")
    same = F.col(key).eqNullSafe(F.col("_right_key")) & (F.col("_part") == F.col("_right_part"))
    return left.join(right, same, how).drop("_part", "_right_key", "_right_part")
