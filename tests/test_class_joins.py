"""Rows meet their class's numbers without a shuffle by class, which would put a frequent class into one task."""

from pyspark.sql import functions as F

from siftworks.operators import models, sampling, tfidf


def test_a_frequent_class_stays_spread(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 100 == 0, 1.0).otherwise(0.0).alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for made in (sampling.stratified_holdout(df, "label", "id"), sampling.oversample(df, "label", "id")):
            rows = made.filter("label = 0").groupBy(F.spark_partition_id()).count().collect()
            assert len(rows) > 1 and max(r["count"] for r in rows) < 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_vectors_of_the_training_rows_are_those_of_the_fitted_model(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "a c c d")], "id long, t string").select("id", F.split("t", " ").alias("terms"))
    model, made = tfidf.TfidfVectors().fit_transform(df)
    assert {r["id"]: r["features"] for r in made.collect()} == {r["id"]: r["features"] for r in model.transform(df).collect()}
    assert "terms" not in made.columns


def test_class_weights_do_not_move_the_rows(spark):
    df = spark.range(400).select("id", (F.col("id") % 20 == 0).cast("int").alias("good"), F.concat_ws(" ", F.lit("common"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("text"))
    found = {(r["model"], r["metric"]) for r in models.evaluate_text(df, F.col("text"), "good", "id", balance=True).collect()}
    assert len(found) == 15
