"""Corpus pipeline: quality, near duplicates, decontamination, secrets, packing.

``run`` applies the stages to ``documents``; every stage reads the Parquet files its predecessor left in the
shared folder, so a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.cotrain import classify_quality
from tallyfold.llm.credentials import redact
from tallyfold.llm.decontaminate import decontaminate
from tallyfold.llm.minhash import drop_near_duplicates
from tallyfold.llm.packing import pack
from tallyfold.session import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# SQL cannot train the classifier of the first stage; tests compare the later ones with brute force.
ORACLE_SQL: str | None = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = classify_quality(docs, labels, carry=docs.columns, prefix="_quality_")
    return judged.filter("_quality_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked at 0.8 or more on five-word shingles."""
    return drop_near_duplicates(docs, size=5, percent=80, bands=40)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate(docs, items, carry=docs.columns, prefix="_bench_")
    return judged.filter(~F.col("_bench_contaminated")).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret masked; n_chars follows where the text changed."""
    return redact(docs, size_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
