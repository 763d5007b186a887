"""Fold predictions: folds are fitted together, and one scan of the test rows gives the predictions of every model."""

import threading

from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes
from pyspark.sql import functions as F

from siftworks.operators import models, sampling


def rows_of(spark):
    df = spark.range(60).select("id", (F.col("id") % 2).cast("double").alias("label"), ((F.col("id") * 7) % 13).cast("double").alias("x"))
    return sampling.hashed_folds(df, "id", 2)


class Meeting:
    """Fits when two folds have come to fit at the same time."""

    def __init__(self, barrier):
        self.barrier = barrier

    def fit(self, train):
        self.barrier.wait()
        return NaiveBayes(modelType="gaussian").fit(train)


def test_folds_are_fitted_together(spark):
    barrier = threading.Barrier(2, timeout=60)
    pred, log = models.fold_predictions(rows_of(spark), ["x"], [], "id", {"plain": models.CleanSpec(), "broken": models.CleanSpec(scaler="none of these")}, lambda: {"gnb": Meeting(barrier)}, 2)
    assert [entry[:2] for entry in log] == [("plain", True), ("broken", False)] and "none of these" in log[1][2]
    assert {r["fold"]: r["n"] for r in pred.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {
        r["fold"]: r["n"] for r in rows_of(spark).groupBy("fold").agg(F.count("*").alias("n")).collect()}


def test_predictions_of_all_models_in_one_scan_are_those_of_each_model(spark):
    made = {"tree": DecisionTreeClassifier(maxDepth=2), "gnb": NaiveBayes(modelType="gaussian")}
    together, _ = models.fold_predictions(rows_of(spark), ["x"], [], "id", {"plain": models.CleanSpec()}, lambda: dict(made), 2)
    for name, one in made.items():
        alone, _ = models.fold_predictions(rows_of(spark), ["x"], [], "id", {"plain": models.CleanSpec()}, lambda: {name: one}, 2)
        assert sorted(alone.collect()) == sorted(together.filter(F.col("model") == name).collect())
