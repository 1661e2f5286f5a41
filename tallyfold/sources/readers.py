"""File readers for annotations, corpora, topics, runs and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.constants import ANNOTATION_SCHEMA
from tallyfold.operators.joins import file_stem
from tallyfold.sources.packed import read_packed
from tallyfold.sources.records import SPLIT_BYTES, read_marked


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation CSV; the header line is skipped and names come by position."""
    return spark.read.schema(ANNOTATION_SCHEMA).option("header", True).option("enforceSchema", True).csv(path)


def _fields(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """White-space separated text; blank lines are skipped, a line with too few fields is an error."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    lines = spark.read.text(path)
    folders = [c for c in lines.columns if c != "value"]
    short = F.raise_error(F.concat(F.lit(f"fewer than {len(names)} fields: "), F.col("value")))
    whole = F.when(F.size(parts) >= len(names), parts).otherwise(short)
    rows = lines.filter(F.trim("value") != "").select(
        whole.alias("p"), F.col("_metadata.file_name").alias("file"), *folders
    )
    return rows.select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)], "file", *folders)


def _judgements(rows: DataFrame, header: bool = False) -> DataFrame:
    """Integer labels; anything else is an error.

    With ``header`` a line that holds the column names (in any case, with or without ``id``: ``topicID``,
    ``topic_id``, ``topic``) is the header line and is skipped.
    """
    if header:
        names = ["topic_id", "worker_id", "doc_id", "gold", "label"]
        plain = [F.regexp_replace(F.lower(F.col(n)), "_?id$", "") for n in names]
        rows = rows.filter(F.concat_ws(" ", *plain) != "topic worker doc gold label")
    for name in ("gold", "label"):
        value = F.col(name).try_cast("int")
        wrong = F.raise_error(F.concat(F.lit(f"{name} is not an integer: "), F.col(name)))
        rows = rows.withColumn(name, F.when(value.isNotNull(), value).otherwise(wrong))
    return rows.drop("file")


def read_judgements_2010(spark: SparkSession, path: str) -> DataFrame:
    return _judgements(_fields(spark, path, ["topic_id", "worker_id", "doc_id", "gold", "label"]), header=True)


def read_judgements_2011(spark: SparkSession, path: str) -> DataFrame:
    """Six columns without header; labels stay graded."""
    return _judgements(_fields(spark, path, ["topic_id", "assignment_id", "worker_id", "doc_id", "gold", "label"]))


def read_corpus(spark: SparkSession, path: str, doc_id: Column | None = None, packed: bool = False) -> DataFrame:
    """Folder of text files (recursive, hidden files skipped) as ``(doc_id, text)``.

    The id is the file name unless ``doc_id`` derives it from ``_metadata``.  One
    file is one row; use :func:`read_corpus_table` for corpora kept as Parquet.
    With ``packed`` a file holds any number of documents with their ids
    (:func:`tallyfold.sources.packed.write_packed`) and many tasks read it; ``doc_id`` may change the id.
    """
    if packed:
        rows = read_packed(spark, path)
        return rows if doc_id is None else rows.withColumn("doc_id", doc_id)
    if doc_id is None:
        doc_id = file_stem(F.col("_metadata.file_name"))
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select(doc_id.alias("doc_id"), F.col("value").alias("text"))
    )


def read_corpus_records(
    spark: SparkSession, path: str, marker: str = "<DOC>", doc_id: str = r"<DOCNO>\s*(\S+)\s*</DOCNO>", split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """``(doc_id, text)`` of files that hold many documents, read by byte ranges.

    A document begins with ``marker``; its id is the first group of the pattern ``doc_id`` and its text the whole
    record without marker and id.  A document without an id is an error.
    """
    found = F.regexp_extract("value", doc_id, 1)
    missing = F.raise_error(F.concat(F.lit("document without id at byte "), F.col("place").cast("string"), F.lit(" of "), F.col("file")))
    body = F.regexp_replace(F.substring(F.col("value"), len(marker) + 1, 2**31 - 1), f"^(?s)(.*?){doc_id}", "$1")
    return read_marked(spark, path, marker, split_bytes).select(
        F.when(found != "", found).otherwise(missing).alias("doc_id"), F.trim(body, F.lit(" \n\r\t")).alias("text")
    )


def read_corpus_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("doc_id", "text")


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """Colon-separated topics in Latin-1: field 0 is the id, field 2 the query.

    Blank lines are skipped; a line with fewer than three fields is an error.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").csv(path, schema="value string")
    parts = F.split("value", ":")
    short = F.raise_error(F.concat(F.lit("fewer than 3 fields: "), F.col("value")))
    whole = F.when(F.size(parts) >= 3, parts).otherwise(short)
    return lines.filter(F.trim("value") != "").select(
        F.trim(whole[0]).alias("topic_id"), F.trim(whole[2]).alias("text")
    )


def read_tagged_topics(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Tagged topics: the query is the title plus the line after ``<desc>``.

    A file is read whole by one task unless ``split_bytes`` is given: then byte ranges of that size are read by tasks of
    their own, with the same rows (:mod:`tallyfold.sources.records`; files are opened by pyarrow).
    """
    if split_bytes is None:
        block = F.explode(
            F.regexp_extract_all(F.col("value"), F.lit(r"(?s)<num>.*?(?=<num>|\z)"), F.lit(0))
        )
        topics = spark.read.text(path, wholetext=True).select(block.alias("b"))
    else:
        topics = read_marked(spark, path, "<num>", split_bytes).select(F.col("value").alias("b"))
    number = F.regexp_replace(F.regexp_extract("b", r"<num>([^\n]*)", 1), "Number:", "")
    title = F.regexp_extract("b", r"<title>([^\n]*)", 1)
    desc = F.regexp_extract("b", r"<desc>[^\n]*\n([^\n]*)", 1)
    return topics.select(
        F.trim(number).alias("topic_id"), F.trim(F.concat_ws(" ", F.trim(title), F.trim(desc))).alias("text")
    )


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Ranked runs, one file (or one ``run=<name>`` folder) per run, named after it."""
    rows = _fields(spark, path, ["topic_id", "dummy", "doc_id", "rank", "score", "team"])
    return rows.select(
        F.col("run") if "run" in rows.columns else F.col("file").alias("run"),
        "topic_id",
        "dummy",
        "doc_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("score").cast("double").alias("score"),
        "team",
    )


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines vectors ``qid, did, pooled_vector``."""
    rows = spark.read.schema("qid string, did string, pooled_vector array<double>").json(path)
    return rows.select(
        F.trim("qid").alias("topic_id"), F.trim("did").alias("doc_id"), F.col("pooled_vector").alias("vec")
    )


def read_feature_sets(spark: SparkSession, root: str, name: str) -> list[tuple[str, DataFrame]]:
    """The tables of a named feature-set combination, stored as ``root/<set>``."""
    from tallyfold.operators.features import FEATURE_SETS

    return [(part, spark.read.parquet(f"{root}/{part}")) for part in FEATURE_SETS[name]]
