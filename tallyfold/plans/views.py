"""Annotation, run, feature and text views over the driver tables.

Every view scans its whole tables.  The matching SQL text is in
:mod:`tallyfold.plans.fragments`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions.textx import tokens
from tallyfold.operators.annotations import task_key
from tallyfold.session import Scratch, shuffle_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topic_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven workers judge every labelled document; ``(topic_id, doc_id, worker_id, gold, label)``."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("topic_id"))
    rows = labels.join(docs, "doc_id").withColumn("worker_id", F.explode(F.sequence(F.lit(0), F.lit(6))))
    d, w = F.col("doc_id"), F.col("worker_id")
    judged = (w == 0) | ((d * 13 + w * 29) % 10 < 6)
    flipped = (d * 31 + w * 17 + d * w * 7) % 100 < w * 6 + 5
    label = F.when(flipped, 1 - F.col("quality")).otherwise(F.col("quality"))
    return rows.filter(judged).select(
        "topic_id", "doc_id", "worker_id", F.col("quality").cast("int").alias("gold"), label.cast("int").alias("label")
    )


def topic_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same annotations keyed by task."""
    return topic_annotations(spark, sf_dir).select(task_key().alias("task_id"), "worker_id", "gold", "label")


def item_annotations(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """Suppliers label parts; duplicates of a (task, worker) occur; ``k`` label values."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    gold = F.col("p_size") % k
    hit = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_suppkey")) % 100 < 10 + F.col(
        "l_suppkey"
    ) % 30
    wrong = 1 - gold if k == 2 else (F.col("p_size") + 1 + F.col("l_linenumber") % 2) % k
    return rows.select(
        F.col("l_partkey").alias("task_id"),
        F.col("l_suppkey").alias("worker_id"),
        gold.cast("int").alias("gold"),
        F.when(hit, wrong).otherwise(gold).cast("int").alias("label"),
    )


def graded_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw graded judgements with unjudged (-1) values."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") % 100).cast("string").alias("topic_id"),
        F.col("l_suppkey").cast("string").alias("worker_id"),
        F.col("l_partkey").cast("string").alias("doc_id"),
        (F.col("p_size") % 4 - 1).cast("int").alias("gold"),
        (F.col("l_linenumber") - 2).cast("int").alias("label"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic_id"), "text")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one query text."""
    n = table(spark, sf_dir, "benchmark").count()
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % n).alias("topic_id"), "doc_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked runs: one per event type; topic = user, document = value bucket."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("event_type").alias("run"),
            F.col("user_id").alias("topic_id"),
            F.floor(F.col("value") / 5).cast("long").alias("doc_id"),
        )
        .agg(F.max("value").alias("score"), F.min("event_id").cast("int").alias("rank"))
        .select("run", "topic_id", "doc_id", "rank", "score")
    )


def doc_features(spark: SparkSession, sf_dir: str, every: bool = True) -> DataFrame:
    """``(doc_id, x_linear, x_rbf)``: a 64-dim embedding and two scalars.

    ``every`` assigns an embedding to every document; otherwise only documents
    whose id is an embedding id have one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    key = F.col("doc_id") % emb.count() if every else F.col("doc_id")
    return docs.withColumn("vec_id", key).join(emb, "vec_id").select(
        "doc_id",
        F.col("embedding").cast("array<double>").alias("x_linear"),
        F.array(F.col("n_chars").cast("double"), F.length("lang").cast("double")).alias("x_rbf"),
    )


def task_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, list[int]]]:
    """Features of the topic tasks, RBF dimensions standardised."""
    from tallyfold.operators.features import attach_features, standardise

    feats = doc_features(spark, sf_dir)
    flat = feats.select("doc_id", "x_linear", F.col("x_rbf")[0].alias("a"), F.col("x_rbf")[1].alias("b"))
    flat = standardise(flat, ["a", "b"])
    ann = topic_annotations(spark, sf_dir)
    tasks = ann.select("doc_id", task_key().alias("task_id")).distinct()
    sets = [
        ("rbf", flat.select("doc_id", F.array("a", "b").alias("v"))),
        ("linear", flat.select("doc_id", F.col("x_linear").alias("v"))),
    ]
    joined, dims = attach_features(tasks, sets, ["doc_id"])
    return joined.select("task_id", "features"), dims


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(term, vec)`` for every token of the queries and the documents."""
    # single precision, as they are stored: they move in half the bytes
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    texts = topics(spark, sf_dir).select("text").unionByName(documents(spark, sf_dir).select("text"))
    # written once, as they are dealt out by term: several steps read them there
    words = texts.select(F.explode(tokens("text")).alias("term")).distinct()
    words = Scratch(spark).cut_by(words, "term", shuffle_partitions(spark), "words")
    slot = (F.ascii("term").cast("long") * 31 + F.length("term") * 7) % emb.count()
    return words.withColumn("vec_id", slot).join(emb, "vec_id").select("term", "vec")


def vote_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(task_id, gold, pred, score)``: majority label and share of positive votes."""
    v2 = item_annotations(spark, sf_dir)
    return v2.groupBy("task_id").agg(
        F.max("gold").alias("gold"),
        F.when(F.sum("label") * 2 >= F.count("*"), 1).otherwise(0).alias("pred"),
        F.avg(F.col("label").cast("double")).alias("score"),
    )
