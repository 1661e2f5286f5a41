"""Run a vectorised function over text columns in bounded slices.

``map_rows`` is the one bridge between Spark and numpy used by the text operators: it streams Arrow
batches, cuts them into slices of a few MB of text (a longer text is a slice of its own), and appends
the result columns.  Columns are renamed on the way, so an input column may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values one after the other, and n + 1 offsets; null counts as empty."""
    arr = arr.fill_null("").cast(pa.large_string())
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(texts: Sequence[pa.Array], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes, or one row."""
    n = len(texts[0])
    size = np.zeros(n, np.int64)
    for arr in texts:
        size += np.diff(text_bytes(arr)[1])
    start = used = 0
    for i, s in enumerate(size.tolist()):
        if i > start and used + s > limit:
            yield start, i
            start, used = i, 0
        used += s
    if n > start:
        yield start, n


def map_rows(
    df: DataFrame,
    inputs: Sequence[str | Column],
    fields: Sequence[tuple[str, str]],
    fn: Callable[..., Sequence],
    carry: Sequence[str] = (),
    prefix: str = "",
    limit: int = SLICE_BYTES,
    texts: int = 1,
) -> DataFrame:
    """``df`` with the columns ``fields`` (name, SQL type) that ``fn`` computes from ``inputs``.

    ``fn`` gets one Arrow array per input and returns one array per field; the first ``texts`` inputs are
    strings and set the slice size.  ``carry`` lists the columns to keep; a carried column whose name
    equals a result's (in any case) gives way to the result.  ``prefix`` renames the results.
    """
    names = [prefix + n for n, _ in fields]
    taken = {n.lower() for n in names}
    carry = [c for c in carry if c.lower() not in taken]
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [
        (c.cast("string") if i < texts else c).alias(f"i{i}")
        for i, c in enumerate(c if isinstance(c, Column) else column(c) for c in inputs)
    ] + [column(c).alias(f"c{i}") for i, c in enumerate(carry)]
    schema = T.StructType(
        [T.StructField(f"c{i}", types[c]) for i, c in enumerate(carry)]
        + T._parse_datatype_string(", ".join(f"r{i} {t}" for i, (_, t) in enumerate(fields))).fields
    )
    n_in = len(inputs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for a, b in slices(batch.columns[:texts], limit):
                part = batch.slice(a, b - a)
                out = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in fn(*part.columns[:n_in])]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[n_in:], *out],
                    names=[f"c{i}" for i in range(len(carry))] + [f"r{i}" for i in range(len(fields))],
                )

    out = df.select(*cols).mapInArrow(run, schema)
    return out.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)],
        *[F.col(f"r{i}").alias(n) for i, n in enumerate(names)],
    )
