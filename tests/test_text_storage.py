"""What text models keep on disk: counts of terms, not texts, and one copy of the training vectors at a time."""

import glob

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from siftworks.operators import models, sampling, tfidf


def written(spark, tmp_path, run):
    """The tables that a run writes, and what it leaves cached."""
    sc, before = spark.sparkContext, spark.sparkContext.getCheckpointDir()
    cached = set(sc._jsc.getPersistentRDDs())
    sc.setCheckpointDir(str(tmp_path))
    try:
        found = run()
    finally:
        sc.setCheckpointDir(before.removeprefix("file:").rsplit("/", 1)[0])
    return found, [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/*/cut-*/*.parquet")], set(sc._jsc.getPersistentRDDs()) - cached


def test_texts_are_neither_written_nor_cached(spark, tmp_path):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("lang"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("word"), (F.col("id") % 3).cast("string"))).alias("text"))
    found, files, cached = written(spark, tmp_path, lambda: models.evaluate_text(df, F.col("text"), "lang", "id").collect())
    assert {r["value"] for r in found if r["metric"] == "accuracy"} == {1.0}
    assert files and not [f for f in files if {"_text", "text", "terms"} & set(f.schema_arrow.names)] and not cached


def test_written_counts_are_read_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tfidf, "GROUP_ROWS", 100)
    df = spark.range(1000).select("id", F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("id") % 7).cast("string"))).alias("terms"))
    (model, made), files, _ = written(spark, tmp_path, lambda: tfidf.TfidfVectors().fit_transform(df))
    assert made.count() == 1000 and max(f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) <= 200


@pytest.mark.parametrize("target", ["label", None])
@pytest.mark.parametrize("keys", ["once", "twice", "null"])
def test_only_keys_are_put_in_order_and_shares_hold(spark, monkeypatch, target, keys):
    key = {"once": F.col("id"), "twice": (F.col("id") / 2).cast("long"), "null": F.when(F.col("id") % 2 == 0, F.col("id"))}[keys]
    df = spark.range(203).select(key.alias("k"), (F.col("id") % 3).alias("label"), F.lit("long text").alias("text"))
    ordered, plain = [], sampling.with_position
    monkeypatch.setattr(sampling, "with_position", lambda rows, *a, **b: ordered.append(rows.columns) or plain(rows, *a, **b))
    rows = sampling.stratified_holdout(df, target, "k").collect()
    assert len(rows) == 203 and set(ordered[0]) <= {"k", "label"}
    if keys == "once":
        assert len(ordered) == 1
    for value in {r["label"] for r in rows} if target else [None]:
        mine = [r for r in rows if target is None or r["label"] == value]
        assert sum(r["is_test"] for r in mine) == max(1, int(np.floor(len(mine) * 0.25 + 0.5)))


def test_classes_are_fitted_on_the_rows_as_they_stand(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(120, 4)), rng.integers(0, 3, 120)
    x += 2 * np.eye(4)[y]
    df = spark.createDataFrame([(i, r.tolist(), float(c)) for i, (r, c) in enumerate(zip(x, y))], "id int, v array<double>, label double").select("id", "label", array_to_vector("v").alias("features"), F.lit(2.0).alias("w")).coalesce(1)
    cached = set(spark.sparkContext._jsc.getPersistentRDDs())
    model = models.OneOverOthers(classifier=LinearSVC(maxIter=3), labelCol="label", weightCol="w").fit(df)
    margins = np.stack([x @ m.coefficients.toArray() + m.intercept for m in model.models], 1)
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert [got[i] for i in range(120)] == margins.argmax(1).tolist() and (margins.argmax(1) == y).mean() > 0.7
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) == cached


def test_terms_of_topics_are_made_twice(spark):
    """Once for the vocabulary and once for the counts; the documents with their topics come from the counts."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        made.add(1)
        return text.split()

    df = spark.range(40).select("id", F.concat_ws(" ", F.lit("common"), F.concat(F.lit("a"), (F.col("id") % 4).cast("string"))).alias("text"))
    docs, top = models.topics(df, split("text"), "id", 2)
    assert docs.count() == 40 and docs.select("share").collect() and top.count() == 10
    assert made.value <= 80
