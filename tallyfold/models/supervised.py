"""Logistic regression on task features and label statistics."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.models.em import Fit
from tallyfold.functions.mathx import dlit, sigmoid
from tallyfold.functions.vectorx import dot
from tallyfold.operators.profile import crowd_features
from tallyfold.session import Scratch

CROWD_COLUMNS = ("label_mean", "label_std", "label_median", "label_max", "label_min")


def design(ann: DataFrame, features: DataFrame) -> DataFrame:
    """``(task_id, x)``: task features followed by the five label statistics."""
    stats = crowd_features(ann)
    joined = features.join(stats, "task_id")
    crowd = F.array(*[F.col(c).cast("double") for c in CROWD_COLUMNS])
    return joined.select(
        "task_id", array_to_vector(F.concat(F.col("features").cast("array<double>"), crowd)).alias("x")
    )


def training_table(rows: DataFrame) -> DataFrame:
    """``(x, y)`` in a written table.

    A fit runs over an RDD, which serialises whatever the plan holds; of a written table that is a plain scan, and the
    joins before it run once.
    """
    return Scratch(rows.sparkSession).cut(rows.select("x", F.col("y").cast("double").alias("y")), "training")


def binary_margin(model, x: Column) -> Column:
    """Margin of label 1 of a fitted binary model over a vector column, without the model inside a function."""
    weights = F.array(*[dlit(w) for w in model.coefficients.toArray()])
    return dot(vector_to_array(x), weights) + dlit(model.intercept)


def binary_probability(model, x: Column) -> Column:
    return sigmoid(binary_margin(model, x))


def classifier_labels(
    train_ann: DataFrame,
    train_features: DataFrame,
    train_gold: DataFrame,
    test_ann: DataFrame,
    test_features: DataFrame,
) -> Fit:
    """Fit on the gold labels of the training tasks, predict the test tasks.

    Penalty ``1 / n`` on the mean loss, unscaled features, up to 10000 iterations.
    """
    train = design(train_ann, train_features).join(train_gold, "task_id")
    train = training_table(train.select("x", F.col("gold").alias("y")))
    n = train.count()
    model = LogisticRegression(
        featuresCol="x", labelCol="y", regParam=1.0 / n, standardization=False, maxIter=10000, tol=1e-6
    ).fit(train)
    test = design(test_ann, test_features)
    if model.numClasses > 2:
        scored = model.transform(test).select(
            "task_id",
            F.col("prediction").cast("int").alias("label"),
            vector_to_array("probability")[1].alias("score"),
        )
    else:
        scored = test.select("task_id", binary_probability(model, F.col("x")).alias("score"))
        scored = scored.select("task_id", (F.col("score") > 0.5).cast("int").alias("label"), "score")
    return Fit("classifier", scored, test_ann.select("worker_id").distinct())
