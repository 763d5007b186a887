"""Fit/transform stages, folds and streaming."""

import numpy as np
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from siftworks.functions.text import TextSpec
from siftworks.operators import features, sampling
from siftworks.streaming.clean import clean_stream, write_stream


def numbers(spark, n=200):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, float(v), None if i % 7 == 0 else float(w)) for i, (v, w) in enumerate(zip(rng.lognormal(0, 1, n), rng.normal(5, 2, n)))], "id long, a double, b double")


def test_stages_chain_in_a_pipeline_and_clip_is_idempotent(spark):
    df = numbers(spark)
    model = Pipeline(stages=[features.ImputeNumber(["a", "b"], "median"), features.ClipOutliers(["a"]), features.Scale(["a", "b"], "standard")]).fit(df)
    out = model.transform(df).toPandas()
    assert abs(out["a"].mean()) < 1e-9 and abs(out["b"].std(ddof=0) - 1) < 1e-9
    clip = features.ClipOutliers(["a"]).fit(df)
    once = clip.transform(df)
    assert once.exceptAll(clip.transform(once)).count() == 0


def test_power_transform_reduces_skew_to_the_best_exponent(spark):
    df = numbers(spark)
    model = features.PowerTransform(["a"]).fit(df)
    x = df.toPandas()["a"].to_numpy()
    def gain(lam):
        t = ((x + 1) ** lam - 1) / lam if abs(lam) > 1e-9 else np.log1p(x)
        return -0.5 * len(x) * np.log(t.var()) + (lam - 1) * np.log1p(x).sum()

    grid = np.linspace(-3, 5, 8001)
    best = grid[np.argmax([gain(v) for v in grid])]
    assert abs(model.params_found["a"] - best) < 0.01
    out = model.transform(df).toPandas()["a"]
    assert abs(out.skew()) < 0.3 and abs(out.mean()) < 1e-9


def test_knn_imputation_equals_brute_force(spark):
    df = numbers(spark, 60)
    got = features.KnnImpute(["a", "b"]).fit(df).transform(df).orderBy("id").toPandas()
    p = df.orderBy("id").toPandas()
    a, b = p["a"].to_numpy(), p["b"].to_numpy()
    have = np.flatnonzero(~np.isnan(b))
    for i in np.flatnonzero(np.isnan(b)):
        near = have[np.argsort(np.abs(a[have] - a[i]), kind="stable")[:5]]
        assert abs(got["b"][i] - b[near].mean()) < 1e-9


def test_fit_never_reads_test_rows(spark):
    df = numbers(spark)
    model = features.OrdinalCodes(["g"]).fit(df.filter("id < 100").withColumn("g", (F.col("id") % 5).cast("string")))
    out = model.transform(df.withColumn("g", (F.col("id") % 8).cast("string")))
    assert {r[0] for r in out.filter("id % 8 > 4").select("g").distinct().collect()} == {-1}


def test_folds_and_oversampling(spark):
    df = numbers(spark).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    folds = sampling.stratified_folds(df, "y", [F.col("id")], 5)
    sizes = folds.groupBy("y", "fold").count().toPandas()
    assert sizes.groupby("y")["count"].agg(lambda s: s.max() - s.min()).max() <= 1 and len(sizes) == 10
    both = sampling.oversample(df, "y", "id").groupBy("y").count().collect()
    assert {r["count"] for r in both} == {180}
    blocks = sampling.time_ordered_blocks(df, [F.col("id")]).groupBy("block").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).orderBy("block").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(blocks, blocks[1:])) and {r["n"] for r in blocks[1:]} == {33}


def test_stream_gets_the_same_cleaning_as_a_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(1, "Visit http://x.y NOW!!!!", 3.0), (2, "b", 100.0)], "id long, text string, v double")
    df.write.parquet(src)
    fitted = features.Scale(["v"], "minmax").fit(df)
    stream = spark.readStream.schema(df.schema).parquet(src)
    write_stream(clean_stream(stream, ["text"], TextSpec(), fitted), out, str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(out).orderBy("id").collect()
    want = clean_stream(df, ["text"], TextSpec(), fitted).orderBy("id").collect()
    assert got == want and got[0]["text_processed"] == "visit url now!"


def test_few_distinct_values_make_as_many_bins(spark):
    from siftworks.operators import rules

    df = spark.createDataFrame([(i, float(i % 3 + 1), float(i % 2), 7.0, float(i) if i < 3 else None) for i in range(12)], "id int, three double, two double, one double, few double")
    assert rules.bin_counts(df, ["three", "two", "one", "few"]) == {"three": 3, "two": 2, "one": 1, "few": 0}
    labels = rules.quartile_labels(df, ["three", "two", "one", "few"])
    groups = {c: {frozenset(v) for v in df.groupBy(x.alias("l")).agg(F.collect_set(c).alias("v")).toPandas()["v"]} for c, x in labels.items()}
    assert groups["three"] == {frozenset({1.0}), frozenset({2.0}), frozenset({3.0})}
    assert len(groups["one"]) == 1
    assert {r["l"] for r in df.select(labels["few"].alias("l")).collect()} == {"0.0", "1.0", "2.0", "nan"}


def test_below_five_transactions_there_are_no_rules(spark):
    from siftworks.operators import rules

    baskets = spark.createDataFrame([(t, i) for t in range(4) for i in "ab"], "txn int, item string")
    found, summary = rules.mine_rules(baskets)
    assert found.count() == 0 and set(summary.first()) == {0}
