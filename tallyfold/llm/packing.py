"""Packing into optimal length buckets.

The exact histogram of token counts over all rows is gathered: one number pair per distinct length.  Texts
with D distinct lengths hold at least D (D - 1) / 2 tokens, so the driver sees at most about the square root
of twice the tokens (100,000 pairs for 5 billion tokens).  Dynamic programming over these lengths picks the
``n_buckets`` bounds with the least total padding; each bound is the longest text of its bucket, at least 1.
Inside a bucket, batches of
max(1, ``token_budget`` // bound) rows are cut from hash slices of about ``slice_rows`` rows, so a bucket
that holds most rows is numbered by many tasks; each slice ends in at most one short batch.  The token counts
are written once with a number for each row, and a slice is a hash of that number: equal rows spread over the slices like
others, and a repeated task finds the same numbers.

The token count is ``length`` if given, else the number of words ``[^\\x20\\x09-\\x0D]+`` of ``text_col``.
Null text or count: 0 tokens, put in the first bucket.  A text longer than the budget is a batch of its own;
nothing is cut or dropped.  Equal rows are packed one by one, in any order.  An empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.rows import column
from tallyfold.session import Scratch

RESULTS = ("n_tokens", "bucket", "bucket_len", "batch_id", "slot", "padding")


def best_bounds(lengths: Sequence[int], counts: Sequence[int], n_buckets: int) -> list[int]:
    """Bounds among ``lengths`` (ascending) whose buckets give the least total padded size.

    Ending a bucket at length j after one that ends at i costs cost[i] + size[j] * (count[j] - count[i]): for
    every i a line in size[j], with slopes that fall as i grows.  The lower envelope of the lines so far is kept,
    and as sizes grow the best line only moves on, so one round is linear in the lengths and exact in integers.
    """
    size, count = [int(x) for x in lengths], [0, *accumulate(int(c) for c in counts)]
    n = len(size)
    k = min(n_buckets, n)
    cost = [0, *(x * c for x, c in zip(size, count[1:]))]
    back = []
    for _ in range(1, k):
        new, cut = [0] * (n + 1), [0] * (n + 1)
        hull: list[int] = []
        best = 0
        for j in range(1, n + 1):
            i = j - 1
            while len(hull) - best >= 2:
                a, b = hull[-2], hull[-1]
                if (cost[i] - cost[a]) * (count[b] - count[a]) > (cost[b] - cost[a]) * (count[i] - count[a]):
                    break
                hull.pop()
            hull.append(i)
            x = size[j - 1]
            while best + 1 < len(hull) and cost[hull[best + 1]] - x * count[hull[best + 1]] <= cost[hull[best]] - x * count[hull[best]]:
                best += 1
            cut[j] = hull[best]
            new[j] = cost[cut[j]] + x * (count[j] - count[cut[j]])
        cost = new
        back.append(cut)
    bounds, j = [], n
    for cut in reversed(back):
        bounds.append(size[j - 1])
        j = cut[j]
        if j == 0:
            break
    if j:
        bounds.append(size[j - 1])
    return bounds[::-1]


def pack(
    docs: DataFrame,
    text_col: str = "text",
    length: str | None = None,
    carry: Sequence[str] = ("doc_id",),
    n_buckets: int = 16,
    token_budget: int = 65536,
    slice_rows: int = 8192,
) -> DataFrame:
    """``carry`` columns of every row with n_tokens, bucket (1 is shortest), bucket_len, batch_id, slot
    (place in the batch) and padding."""
    n_tokens = column(length).cast("bigint") if length else F.regexp_count(column(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = docs.select(*[column(c).alias(f"c{i}") for i, c in enumerate(carry)], F.greatest(F.coalesce(n_tokens, F.lit(0)), F.lit(0)).alias("n"))
    rows = Scratch(docs.sparkSession).cut(rows.withColumn("row", F.monotonically_increasing_id()), "lengths")
    hist = rows.groupBy(F.greatest(F.col("n"), F.lit(1)).alias("bound")).count().orderBy("bound").collect()
    if not hist:
        bounds = [1]
    else:
        bounds = best_bounds([r["bound"] for r in hist], [r["count"] for r in hist], n_buckets)
    at = [0] * len(bounds)
    for r in hist:
        at[bisect_left(bounds, r["bound"])] += r["count"]
    pick = F.array(*[F.lit(int(b)) for b in bounds])
    slices = F.array(*[F.lit(max(1, -(-c // slice_rows))) for c in at])
    bucket = F.size(F.filter(pick, lambda b: b < F.col("n"))) + 1
    rows = rows.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(pick, F.col("bucket")).cast("bigint"))
    rows = rows.withColumn("h", F.xxhash64("row"))
    rows = rows.withColumn("slice", F.pmod(F.col("h"), F.element_at(slices, F.col("bucket"))))
    place = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("h", "row")) - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len")))
    rows = rows.withColumn("place", place)
    taken = set(RESULTS)
    return rows.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry) if c.lower() not in taken],
        F.col("n").alias("n_tokens"), "bucket", "bucket_len",
        F.format_string("%d-%d-%d", F.col("bucket"), F.col("slice"), F.floor(F.col("place") / room)).alias("batch_id"),
        F.pmod(F.col("place"), room).cast("bigint").alias("slot"), (F.col("bucket_len") - F.col("n")).alias("padding"),
    )
