"""Text files that hold many documents: ``id``, a mark, ``text``, a mark.

The marks are control characters; where a text holds one it is written as an escape, so any text comes back whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ESCAPE, ID_END, RECORD_END = "\u0001", "\u0002", "\u0003"
ESCAPED = [(ESCAPE, ESCAPE + "a"), (ID_END, ESCAPE + "b"), (RECORD_END, ESCAPE + "c")]


def escape_marks(text: Column) -> Column:
    for plain, escaped in ESCAPED:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape_marks(text: Column) -> Column:
    for plain, escaped in reversed(ESCAPED):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def write_packed(docs: DataFrame, path: str) -> None:
    """``(doc_id, text)`` as packed files, one per task."""
    record = F.concat(escape_marks(F.col("doc_id").cast("string")), F.lit(ID_END), escape_marks(F.col("text")))
    docs.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", RECORD_END).text(path)
    at = F.instr("value", ID_END)
    doc_id = F.substring(F.col("value"), F.lit(1), at - F.lit(1))
    text = F.substring(F.col("value"), at + F.lit(1), F.length("value"))
    return lines.select(unescape_marks(doc_id).alias("doc_id"), unescape_marks(text).alias("text"))
