"""Tables of small counters, built by all tasks and read by all tasks.

The size is fixed before the first row is read (a power of two up to ``MOST``), so what a task holds, what reaches
the driver and what is broadcast is bounded whatever the input.  A crowded table lets more keys through and
costs work; it never loses a key.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.session import shuffle_partitions

CHUNK = 1 << 16
MOST = 1 << 25


def table_size(expected: int, least: int = CHUNK) -> int:
    """The smallest power of two that is at least ``expected``, within ``least`` and ``MOST``."""
    return min(MOST, max(least, 1 << max(0, int(expected) - 1).bit_length()))


def counters(rows: DataFrame, places: Callable[[pa.RecordBatch], np.ndarray], size: int, top: int = 255) -> np.ndarray:
    """``size`` counters that stop at ``top``; ``places`` names the counters that the rows of a batch raise by one.

    Each task counts in one array and hands on the chunks that are not empty, compressed; chunks of one number
    are added in Spark, and ``size`` bytes reach the driver.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, np.uint8)
        for batch in batches:
            if batch.num_rows:
                at, n = np.unique(places(batch), return_counts=True)
                table[at] = np.minimum(table[at] + np.minimum(n, top), top)
        yield from _packed(enumerate(table.reshape(-1, min(CHUNK, size))))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(zlib.decompress(data), np.uint8)
                tables[i] = np.minimum(tables[i].astype(np.uint16) + more, top).astype(np.uint8) if i in tables else more
        yield from _packed(tables.items())

    chunks = rows.mapInArrow(count, "i int, data binary")
    merged = chunks.repartition(shuffle_partitions(rows.sparkSession), F.col("i")).mapInArrow(add, "i int, data binary")
    out = np.zeros(size, np.uint8).reshape(-1, min(CHUNK, size))
    for r in merged.toLocalIterator():
        out[r["i"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return out.reshape(-1)


def _packed(chunks: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One chunk per record, so that no batch is large."""
    for i, chunk in chunks:
        if chunk.any():
            data = zlib.compress(chunk.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([data], pa.binary())], names=["i", "data"])
