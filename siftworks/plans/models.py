"""Model evaluations; results depend on fitted models, so there is no SQL equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors, models, series, tfidf, vectors
from ..session import spread, table
from .registry import query

PLAIN = models.CleanSpec()
TUNED = models.CleanSpec(num_imputer="median", scaler="robust", outlier_clip=True, encoder="ordinal", remove_low_variance=True, imbalance="oversample")


def order_rows(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        (F.col("o_custkey") % 50).cast("double").alias("cust_band"))


@query("evl01_evl28_multiclass_specs")
def evl01(spark, d):
    specs = {"plain": PLAIN, "tuned": TUNED, "broken": models.CleanSpec(scaler="unknown")}
    return models.evaluate_classification(order_rows(spark, d), "o_orderstatus", ["o_totalprice", "cust_band"], ["o_orderpriority"], "o_orderkey", specs)


@query("evl01_binary")
def evl01_binary(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return models.evaluate_classification(t, "quality", ["n_chars"], ["lang"], "doc_id", {"smote": models.CleanSpec(imbalance="smote")})


@query("evl02_regression")
def evl02(spark, d):
    t = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    return models.evaluate_regression(t, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"], "key", {"plain": PLAIN}, folds=3)


@query("evl03_series_models")
def evl03(spark, d):
    from .tabular import hourly

    frame = series.lag_frame(hourly(spark, d), "y", "hour", [], ["event_type"])
    return models.evaluate_series(frame, "y", ["y_lag_1", "y_lag_2", "y_lag_3"], ["hour", "event_type"], 3)


@query("evl04_clustering")
def evl04(spark, d):
    return models.evaluate_clustering(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("evl05_anomaly_proxy")
def evl05(spark, d):
    return models.evaluate_anomaly(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("evl16_embedding_anomaly")
def evl16(spark, d):
    return models.evaluate_anomaly(table(spark, d, "embeddings"), "vec_id", "embedding", F.col("label") == 0)


@query("evl16_image_anomaly_proxy")
def evl16_images(spark, d):
    return models.evaluate_anomaly(table(spark, d, "embeddings"), "vec_id", "embedding", images=True)


@query("evl05_isolation_forest")
def iforest(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.array(F.col("c_acctbal"), F.col("c_nationkey").cast("double")).alias("v"))
    return detectors.isolation_forest(c, "c_custkey", "v").select("c_custkey", "score")


@query("evl07_text_classification")
def evl07(spark, d):
    t = spread(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")
    return models.evaluate_text(t, F.col("text"), "lang", "doc_id", min_df=2)


@query("evl07_ftr14_fused_classification")
def ftr14(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("n_chars", F.col("n_chars").cast("double"))
    return models.evaluate_text(t, F.col("text"), "quality", "doc_id", balance=True, min_df=2, auxiliary=["n_chars"], categories=["lang", "source"])


@query("evl07_char_classification")
def evl07_char(spark, d):
    t = spread(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id")
    return models.evaluate_text(t, F.col("text"), "lang", "doc_id", min_df=2, terms="char")


@query("evl08_ftr14_fused_multilabel")
def evl08_fused(spark, d):
    """Labels as lists, class weights, a number and two categories beside the text."""
    t = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("n_chars", F.col("n_chars").cast("double"))
    listed = F.concat_ws("|", F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), "lang")
    return models.evaluate_text_multilabel(t.withColumn("tags", listed), F.col("text"), "tags", "doc_id", min_df=2, balance=True, auxiliary=["n_chars"], categories=["lang", "source"])


@query("evl08_text_multilabel")
def evl08(spark, d):
    t = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return models.evaluate_text_multilabel(t, F.col("text"), ["quality", "toxic"], "doc_id", min_df=2)


@query("evl13_met14_topics")
def evl13(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text", "lang")
    return models.evaluate_topics(t, tfidf.word_terms(F.col("text")), "doc_id", "lang")


@query("srt06_topic_terms")
def srt06(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    return models.topics(t, tfidf.word_terms(F.col("text")), "doc_id", 5)[1]


@query("evl14_vector_classification")
def evl14(spark, d):
    return models.evaluate_vectors(table(spark, d, "embeddings"), "embedding", "label", "vec_id")


@query("evl14_vector_multilabel")
def evl14_multi(spark, d):
    t = table(spark, d, "embeddings").withColumns({"low": (F.col("label") < 5).cast("int"), "odd": F.col("label") % 2})
    return models.evaluate_vectors_multilabel(t, "embedding", ["low", "odd"], "vec_id")


@query("evl21_perceptron_classification")
def evl21(spark, d):
    return models.evaluate_vectors(table(spark, d, "embeddings"), "embedding", "label", "vec_id", lambda n, k: models.perceptrons(n, k, 20), scale=True)


@query("smp06_smote_sizes", "SELECT quality::DOUBLE AS label, (SELECT max(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) AS n FROM labels GROUP BY quality")
def smp06(spark, d):
    from pyspark.ml.functions import array_to_vector

    t = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    rows = t.select("doc_id", F.col("quality").cast("double").alias("label"), array_to_vector(F.array(F.col("n_chars").cast("double"), F.length("lang").cast("double"))).alias("features"))
    return models.smote(rows, "doc_id").groupBy("label").agg(F.count("*").alias("n"))
