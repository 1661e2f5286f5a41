"""Semi-joins and lookups between annotations, corpus, topics and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_stem(path: str | Column) -> Column:
    """Document id of a corpus file: its base name without a trailing .txt."""
    c = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.txt$", "")


def in_corpus(ann: DataFrame, corpus: DataFrame) -> DataFrame:
    """Annotations whose document is in the corpus."""
    return ann.join(corpus.select("doc_id").distinct(), "doc_id", "left_semi")


def judged_runs(runs: DataFrame, ann: DataFrame) -> DataFrame:
    """Run rows whose topic is judged and whose document is judged (independently)."""
    return runs.join(ann.select("topic_id").distinct(), "topic_id", "left_semi").join(
        ann.select("doc_id").distinct(), "doc_id", "left_semi"
    )


def topic_texts(topics: DataFrame, texts: DataFrame, on_missing: str = "error") -> DataFrame:
    """Attach each topic's text; a topic without text is an error (or dropped)."""
    joined = topics.select("topic_id").distinct().join(texts, "topic_id", "left")
    if on_missing == "drop":
        return joined.filter(F.col("text").isNotNull())
    missing = F.raise_error(F.concat(F.lit("no text for topic "), F.col("topic_id").cast("string")))
    return joined.withColumn("text", F.when(F.col("text").isNotNull(), F.col("text")).otherwise(missing))


def with_task_values(ann: DataFrame, values: DataFrame) -> DataFrame:
    """Annotations with the gold label or features of their task."""
    return ann.join(values, "task_id")
