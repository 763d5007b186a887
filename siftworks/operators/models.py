"""Fold-aware model evaluation with spark.ml.

Cleaning is fitted on the training rows of every fold. All predictions of all specs, models and folds end up in one long
table that a single grouping turns into metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest)
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Summarizer
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..functions.text import parse_list
from ..session import cut_lineage
from . import detectors, features, linear, metrics, neighbours, sampling, tfidf, vectors
from . import topics as topic_models
from .blocks import sparse_parts

SEED = 42
#: The vector column of all one-hot categories.
ONE_HOT = "_onehot"


@dataclass(frozen=True)
class CleanSpec:
    """One candidate: how to clean a table before a model sees it."""

    num_imputer: str = "mean"
    cat_imputer: str = "mode"
    scaler: str = "standard"
    power_transform: bool = False
    encoder: str = "onehot"
    remove_duplicates: bool = False
    remove_low_variance: bool = False
    imbalance: str = "none"
    outlier_clip: bool = False
    drop_high_missing_cols: bool = False

    def stages(self, num: Sequence[str], cat: Sequence[str], vectors_of_categories: bool = True) -> list:
        out: list = []
        if num:
            out.append(features.KnnImpute(num) if self.num_imputer == "knn" else features.ImputeNumber(num, self.num_imputer))
            if self.outlier_clip:
                out.append(features.ClipOutliers(num))
            if self.power_transform:
                out.append(features.PowerTransform(num))
            if self.scaler != "none":
                out.append(features.Scale(num, self.scaler))
        if cat:
            out.append(features.ImputeCategory(cat, self.cat_imputer))
            if self.encoder != "onehot":
                out.append(features.OrdinalCodes(cat))
            else:
                out.append(features.OneHotVectors(cat, ONE_HOT) if vectors_of_categories else features.OneHot(cat, numbered=True))
        return out


@dataclass
class FittedClean:
    """``kept``: numeric columns of the feature vector; ``hot``: places kept of the category vector, None for all."""

    stages: list
    kept: list[str]
    hot: list[int] | None = None

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        before = set(df.columns)
        for s in self.stages:
            df = s.transform(df)
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.kept})
        parts = list(self.kept)
        if ONE_HOT in df.columns and self.hot != []:
            if self.hot is not None:
                df = VectorSlicer(inputCol=ONE_HOT, outputCol="_sliced", indices=self.hot).transform(df).drop(ONE_HOT).withColumnRenamed("_sliced", ONE_HOT)
            parts.append(ONE_HOT)
        done = VectorAssembler(inputCols=parts, outputCol=out).transform(df)
        return done.drop(ONE_HOT, *[c for c in self.kept if c not in before])

    def columns_model(self) -> Model:
        """The column stages alone, for writing cleaned tables instead of feature vectors."""
        return PipelineModel(self.stages)


def fit_clean(spec: CleanSpec, train: DataFrame, num: Sequence[str], cat: Sequence[str], vectors_of_categories: bool = True) -> FittedClean:
    stages, df = [], train.select(*num, *cat)
    for estimator in spec.stages(num, cat, vectors_of_categories):
        model = estimator.fit(df)
        stages.append(model)
        df = model.transform(df)
    kept, hot = [c for c in df.columns if c != ONE_HOT], None
    if spec.remove_low_variance:
        gone = set(features.LowVariance(kept).fit(df).dropped) if kept else set()
        if ONE_HOT in df.columns:
            row = df.select(Summarizer.metrics("count", "variance").summary(F.col(ONE_HOT)).alias("s")).select("s.*").first()
            hot = np.flatnonzero(row["variance"].toArray() * max(row["count"] - 1, 0) > features.MIN_VARIANCE * max(row["count"], 1)).tolist()
        if len(gone) < len(kept) or hot:
            kept = [c for c in kept if c not in gone]
        else:
            hot = None
    return FittedClean(stages, kept, hot)


def classifiers() -> dict:
    return {
        "logreg": LogisticRegression(maxIter=50, labelCol="label"),
        "tree": DecisionTreeClassifier(maxDepth=6, seed=SEED, labelCol="label"),
        "gnb": NaiveBayes(modelType="gaussian", labelCol="label"),
    }


def regressors() -> dict:
    return {
        "linear": LinearRegression(labelCol="label"),
        "tree": DecisionTreeRegressor(maxDepth=6, seed=SEED, labelCol="label"),
        "forest": RandomForestRegressor(numTrees=40, maxDepth=6, seed=SEED, labelCol="label"),
    }


def perceptrons(n_features: int, n_classes: int, iterations: int = 100) -> dict:
    return {
        "mlp_64_32": MultilayerPerceptronClassifier(layers=[n_features, 64, 32, n_classes], maxIter=iterations, seed=SEED, labelCol="label"),
        "mlp_32": MultilayerPerceptronClassifier(layers=[n_features, 32, n_classes], maxIter=iterations, seed=SEED, labelCol="label"),
    }


def _predict(name: str, model, test: DataFrame, fold, spec_id: str) -> DataFrame:
    out = model.transform(test)
    score = F.col("prediction")
    if "probability" in out.columns:
        score = vector_to_array("probability")[F.greatest(F.size(vector_to_array("probability")) - 1, F.lit(0))]
    return out.select(
        F.lit(spec_id).alias("spec_id"), F.lit(name).alias("model"), F.lit(fold).alias("fold"),
        F.col("label").alias("y"), F.col("prediction").alias("pred"), score.alias("score"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def balanced(train: DataFrame, mode: str, key: str) -> DataFrame:
    """Training rows after the spec's imbalance handling (label and features columns)."""
    if mode == "oversample":
        return sampling.oversample(train, "label", key).drop("copy")
    if mode == "smote":
        return smote(train, key)
    return train


def smote(train: DataFrame, key: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Minority rows plus synthetic ones between a row and one of its nearest rows of the same class, until every class
    has the majority size. Falls back to the input when a class has a single row."""
    sizes = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    top = max(sizes.values())
    if len(sizes) < 2 or min(sizes.values()) < 2:
        return train
    near_k = max(1, min(k, min(sizes.values()) - 1))
    base = train.select(key, "label", vector_to_array("features").alias("_x"))
    parts = [train.select("label", "features")]
    for label, n in sizes.items():
        extra = top - n
        if extra <= 0:
            continue
        rows = base.filter(F.col("label") == F.lit(label))
        edges = neighbours.nearest(rows, key, "_x", near_k)
        order = [sampling.shuffle_key(key, seed), F.col(key)]
        pos = sampling.with_position(rows, order, name="_p")
        copies = F.lit(extra // n) + F.when(F.col("_p") <= extra % n, 1).otherwise(0)
        want = pos.filter(copies > 0).withColumn("_c", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        draw = F.xxhash64(F.col(key), F.col("_c"), F.lit(seed))
        want = want.withColumn("rank", (F.pmod(draw, F.lit(near_k)) + 1).cast("int")).withColumn("_u", F.pmod(F.shiftright(draw, 8), F.lit(1 << 30)) / float(1 << 30))
        other = rows.select(F.col(key).alias("neighbour"), F.col("_x").alias("_y"))
        made = want.join(edges.select(key, "rank", "neighbour"), [key, "rank"]).join(other, "neighbour")
        u = F.col("_u")
        mixed = F.transform(F.arrays_zip("_x", "_y"), lambda p: p["_x"] + u * (p["_y"] - p["_x"]))
        parts.append(made.select("label", array_to_vector(mixed).alias("features")))
    return _union(parts)


def indexed(df: DataFrame, target: str) -> tuple[DataFrame, list[str]]:
    """Label column 0..k-1 in sorted order and the label names."""
    rows = df.withColumn("_target", F.col(target).cast("string")).drop("label")
    model = StringIndexer(inputCol="_target", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    out = model.transform(rows)
    return (out if target == "label" else out.drop("_target")), list(model.labels)


#: Folds that are fitted at a time, from threads of the driver; each has its training rows cached meanwhile.
FITS_AT_ONCE = 6


def _predict_all(fitted: Mapping[str, Model], test: DataFrame, fold: int, spec_id: str) -> DataFrame:
    """Predictions of all models in one scan of the test rows."""
    out, cells = test, []
    for i, (name, model) in enumerate(fitted.items()):
        out = model.transform(out)
        prob = vector_to_array("probability") if "probability" in out.columns else None
        score = F.col("prediction") if prob is None else prob[F.greatest(F.size(prob) - 1, F.lit(0))]
        out = out.withColumns({f"_p{i}": F.col("prediction"), f"_s{i}": score}).drop("prediction", "rawPrediction", "probability")
        cells.append(F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("pred"), F.col(f"_s{i}").alias("score")))
    out = out.select("label", F.inline(F.array(*cells)))
    return out.select(F.lit(spec_id).alias("spec_id"), "model", F.lit(fold).alias("fold"), F.col("label").alias("y"), "pred", "score")


def fold_predictions(df: DataFrame, num: Sequence[str], cat: Sequence[str], key: str, specs: Mapping[str, CleanSpec],
                     models: Callable[[], dict], folds: int, fold: str = "fold") -> tuple[DataFrame | None, list[tuple]]:
    """Predictions of every spec, model and fold, and (spec, success, reason, seconds of its folds) per spec. Folds are
    independent of each other, so several are fitted at a time; their predictions are written as they come."""
    rows = cut_lineage(df.select(*dict.fromkeys([key, "label", fold, *num, *cat])))

    def one(spec_id: str, f: int) -> tuple[DataFrame | None, str, float]:
        start, spec, cached = time.time(), specs[spec_id], []
        try:
            train, test = rows.filter(F.col(fold) != f), rows.filter(F.col(fold) == f)
            if spec.remove_duplicates:
                train = features.keep_first(train, [*num, *cat], key)
            clean = fit_clean(spec, train, num, cat)
            fitted_train = balanced(clean.transform(train).select(key, "label", "features"), spec.imbalance, key).persist()
            cached.append(fitted_train)
            fitted = {name: est.fit(fitted_train) for name, est in models().items()}
            return cut_lineage(_predict_all(fitted, clean.transform(test).select("label", "features"), f, spec_id)), "", time.time() - start
        except (ValueError, AnalysisException, IllegalArgumentException) as exc:  # a spec that does not fit these data
            return None, str(exc)[:300] or type(exc).__name__, time.time() - start
        finally:
            for c in cached:
                c.unpersist()

    tasks = [(spec_id, f) for spec_id in specs for f in range(folds)]
    with ThreadPool(min(FITS_AT_ONCE, len(tasks))) as pool:
        done = pool.starmap(inheritable_thread_target(df.sparkSession)(one), tasks, 1)
    parts, log = [], []
    for spec_id in specs:
        mine = [d for (s, _), d in zip(tasks, done) if s == spec_id]
        reason = next((r for p, r, _ in mine if p is None), "")
        if not reason:
            parts += [p for p, _, _ in mine]
        log.append((spec_id, not reason, reason, sum(t for _, _, t in mine)))
    return (_union(parts) if parts else None), log


def evaluate_classification(df: DataFrame, target: str, num: Sequence[str], cat: Sequence[str], key: str,
                            specs: Mapping[str, CleanSpec], models: Callable[[], dict] = classifiers) -> DataFrame:
    """(spec_id, metric, mean, std, normalized) over models and folds; a failed spec has the metric ``failed``."""
    labelled, names = indexed(df.dropna(subset=[target]), target)
    k = sampling.fold_count(labelled, "label")
    folded = sampling.stratified_folds(labelled, "label", [sampling.shuffle_key(key), F.col(key)], k)
    pred, log = fold_predictions(folded, num, cat, key, specs, models, k)
    keys = ["spec_id", "model", "fold"]
    long = None
    if pred is not None:
        if len(names) == 2:
            auc = metrics.roc_auc(pred, keys)
            long = metrics.binary_metrics(pred, keys, 1.0).unionByName(auc)
        else:
            long = metrics.multiclass_metrics(pred, keys)
    return summarize(df, long, log)


def evaluate_regression(df: DataFrame, target: str, num: Sequence[str], cat: Sequence[str], key: str,
                        specs: Mapping[str, CleanSpec], models: Callable[[], dict] = regressors, folds: int = 5) -> DataFrame:
    rows = df.withColumn("label", F.expr(f"try_cast(`{target}` AS double)")).dropna(subset=["label"])
    folded = sampling.hashed_folds(rows, key, folds)
    pred, log = fold_predictions(folded, num, cat, key, specs, models, folds)
    long = None if pred is None else metrics.regression_metrics(pred, ["spec_id", "model", "fold"]).filter("metric IN ('mae', 'rmse', 'r2')")
    scale = metrics.error_scales(rows, "label").first()["error_scale"]
    return summarize(df, long, log, scale)


def summarize(df: DataFrame, long: DataFrame | None, log: Sequence[tuple], scale: float = 1.0) -> DataFrame:
    """Mean and deviation over models, the score in [0, 1], and a zero row for each failed spec."""
    spark = df.sparkSession
    notes = spark.createDataFrame(log, "spec_id string, success boolean, reason string, elapsed double")
    failed = notes.filter("NOT success").select("spec_id", F.lit("failed").alias("metric"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("std"))
    out = failed if long is None else metrics.across_models(long, ["spec_id"]).unionByName(failed)
    out = out.withColumn("normalized", metrics.normalized(F.col("metric"), F.col("mean"), F.lit(float(scale))))
    return out.join(notes.select("spec_id", "success", "reason"), "spec_id")


def evaluate_series(frame: DataFrame, target: str, feature_cols: Sequence[str], order: Sequence[str], folds: int | None = None) -> DataFrame:
    """Last value, linear and tree forecasts on expanding windows; errors averaged over folds per model."""
    rows = sampling.time_ordered_blocks(frame.withColumn("label", F.col(target).cast("double")), [F.col(c) for c in order], folds)
    rows = VectorAssembler(inputCols=list(feature_cols), outputCol="features").transform(rows).persist()
    last = rows.agg(F.max("block")).first()[0]
    parts = [rows.filter("block > 0").select(
        F.lit("raw").alias("spec_id"), F.lit("naive").alias("model"), F.col("block").alias("fold"), F.col("label").alias("y"),
        F.col(f"{target}_lag_1").alias("pred"), F.col(f"{target}_lag_1").alias("score"))]
    for name in ("linear", "tree"):
        for f in range(1, last + 1):
            model = regressors()[name].fit(rows.filter(F.col("block") < f))
            parts.append(_predict(name, model, rows.filter(F.col("block") == f), f, "raw"))
    long = metrics.regression_metrics(_union(parts), ["model", "fold"]).filter("metric <> 'r2'")
    return long.groupBy("model", "metric").agg(F.avg("value").alias("value"))


def evaluate_clustering(df: DataFrame, key: str, vec: str, eps: float = 0.7) -> DataFrame:
    """(model, metric, value): k-means, bisecting k-means and density clusters; a collapsed clustering has no rows."""
    n = df.count()
    k = vectors.cluster_count(n)
    rows = df.withColumn("features", array_to_vector(F.col(vec))).persist()
    found = {
        "kmeans": KMeans(k=k, seed=SEED).fit(rows).transform(rows).select(key, F.col("prediction").cast("long").alias("cluster")),
        "hierarchical": BisectingKMeans(k=k, seed=SEED).fit(rows).transform(rows).select(key, F.col("prediction").cast("long").alias("cluster")),
        "dbscan": detectors.dbscan(rows, key, vec, eps),
    }
    parts = []
    for name, assigned in found.items():
        both = rows.select(key, vec).join(assigned, key).persist()
        index = vectors.cluster_indices(both, vec, "cluster")
        if index.isEmpty():
            continue
        parts.append(index.unionByName(vectors.silhouette(both, key, vec, "cluster")).withColumn("model", F.lit(name)))
    if not parts:
        raise ValueError("every clustering collapsed")
    return _union(parts).select("model", "metric", "value")


def evaluate_anomaly(df: DataFrame, key: str, vec: str, truth: Column | None = None, k: int = 20, images: bool = False) -> DataFrame:
    """(model, metric, value) of isolation forest, local outlier factor and PCA reconstruction. With a 0/1 truth that
    travels with the rows the metrics are supervised, else proxies, of which ``images`` have their own."""
    rows = (df.withColumn("y", truth.cast("int")) if truth is not None else df).persist()
    share = vectors.contamination(rows.count())
    d = vectors.dimension(rows, vec)
    scored = {
        "isolation_forest": detectors.isolation_forest(rows, key, vec),
        "lof": rows.join(detectors.local_outlier_factor(rows, key, vec, k), key),
        "pca": vectors.pca_reconstruction(rows, vec, max(1, d // 3)),
    }
    parts = []
    for name, s in scored.items():
        flagged = vectors.flag_top(s.persist(), "score", share)
        if truth is not None:
            m = vectors.anomaly_supervised(flagged, "y")
        else:
            m = vectors.image_anomaly_proxy(flagged) if images else vectors.anomaly_proxy(flagged, key)
        parts.append(m.withColumn("model", F.lit(name)))
    return _union(parts).select("model", "metric", "value")


class OneOverOthers(OneVsRest):
    """OneVsRest on rows that stand in a table: they are read for every class, not kept a second time beside what a class's
    fit keeps, and scored in one scan without Python."""

    def _fit(self, dataset: DataFrame) -> OneOverOthersModel:
        label, classifier = self.getLabelCol(), self.getClassifier()
        names = {classifier.labelCol: "_one", classifier.featuresCol: self.getFeaturesCol()}
        if self.isDefined(self.weightCol):
            names[classifier.weightCol] = self.getWeightCol()
        top = int(dataset.agg(F.max(label)).first()[0])
        return OneOverOthersModel([
            classifier.fit(dataset.withColumn("_one", F.when(F.col(label) == float(i), 1.0).otherwise(0.0)), names) for i in range(top + 1)])


@dataclass
class OneOverOthersModel:
    models: list

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction``: the class of the largest margin, the first of equal ones."""
        out, margins = df, [f"_margin{i}" for i in range(len(self.models))]
        for name, m in zip(margins, self.models):
            out = m.transform(out).withColumn(name, vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")
        every = F.array(*margins)
        return out.withColumn("prediction", (F.array_position(every, F.array_max(every)) - 1).cast("double")).drop(*margins)


def text_classifiers(balance: bool) -> dict:
    extra = {"weightCol": "weight"} if balance else {}
    return {
        "tfidf_logistic_regression": LogisticRegression(maxIter=50, labelCol="label", **extra),
        "tfidf_linear_svc": OneOverOthers(classifier=LinearSVC(maxIter=30), labelCol="label", **extra),
        "tfidf_multinomial_nb": NaiveBayes(modelType="multinomial", labelCol="label", **extra),
    }


#: How auxiliary columns are cleaned before they stand beside text.
BESIDE_TEXT = CleanSpec(cat_imputer="constant")


def text_features(train: DataFrame, test: DataFrame, terms: Column, min_df: int = 1, max_terms: int = tfidf.MAX_TERMS,
                  auxiliary: Sequence[str] = (), categories: Sequence[str] = (), spec: CleanSpec = BESIDE_TEXT) -> tuple[DataFrame, DataFrame]:
    """TF-IDF vectors fitted on the training rows, with auxiliary numbers and categories behind them: imputed, scaled and
    coded as ``spec`` says, all learned from the training rows. Vectors stay sparse. Texts end here: what is written beside
    the counts of their terms are the other columns."""
    counts = tfidf.TfidfVectors("terms", "features", min_df, max_terms)
    train, test = (x.withColumn("terms", terms).drop("_text") for x in (train, test))
    model, tr = counts.fit_transform(train)
    te = counts.stored(model, test)
    if auxiliary or categories:
        names = {c: f"_cat_{i}" for i, c in enumerate(categories)}  # the columns themselves stay
        with_copies = lambda x: x.withColumns({n: F.col(c) for c, n in names.items()})
        aux = fit_clean(spec, with_copies(tr), list(auxiliary), list(names.values()))
        fuse = VectorAssembler(inputCols=["features", "_aux"], outputCol="fused")
        tr, te = (fuse.transform(aux.transform(with_copies(x), "_aux")).drop("features", "_aux").withColumnRenamed("fused", "features") for x in (tr, te))
    return tr, te


TERMS = {"word": tfidf.word_terms, "char": tfidf.char_terms}


def evaluate_text(df: DataFrame, text: Column, target: str, key: str, balance: bool = False, min_df: int = 1,
                  max_terms: int = tfidf.MAX_TERMS, auxiliary: Sequence[str] = (), categories: Sequence[str] = (), terms: str = "word",
                  spec: CleanSpec = BESIDE_TEXT) -> DataFrame:
    """(model, metric, value) on a stratified 75/25 split of non-blank labelled rows, on word or character terms."""
    rows, _ = indexed(df.withColumn("_text", text).filter((F.trim("_text") != "") & (F.trim(F.col(target).cast("string")) != "")), target)
    rows = sampling.stratified_holdout(rows.select(*dict.fromkeys([key, "label", *auxiliary, *categories, "_text"])), "label", key)
    train, test = rows.filter("NOT is_test"), rows.filter("is_test")
    if balance:
        train = train.join(F.broadcast(sampling.class_weights(train, "label").select("label", "weight")), "label")
    train, test = text_features(train, test, TERMS[terms](F.col("_text")), min_df, max_terms, auxiliary, categories, spec)

    def one(name: str, est) -> DataFrame:
        tr, te = train, test
        if auxiliary and "nb" in name:
            # Naive Bayes needs non-negative values, and the auxiliary ones are centred.
            flip = F.transform(vector_to_array("features"), lambda v: F.abs(v))
            tr, te = (x.withColumn("features", array_to_vector(flip)) for x in (train, test))
        return cut_lineage(_predict(name, est.fit(tr), te, 0, "text"))

    # One after the other: each keeps a copy of the training vectors while it is fitted.
    parts = [one(name, est) for name, est in text_classifiers(balance).items()]
    return metrics.multiclass_metrics(_union(parts), ["model"])


def label_places(df: DataFrame, labels: str | Sequence[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(key, y) and (label, code): the sorted codes of each row's labels, and the labels that some but not all rows have,
    in sorted order. ``labels`` names a column of lists or several 0/1 columns."""
    if isinstance(labels, str):
        cells = F.array_distinct(parse_list(F.col(labels)) if dict(df.dtypes)[labels] == "string" else F.transform(F.col(labels), lambda v: F.trim(v.cast("string"))))
    else:
        cells = F.filter(F.array(*[F.when(F.expr(f"try_cast(`{c}` AS double)") == 1, F.lit(c)) for c in labels]), lambda v: v.isNotNull())
    held = df.select(key, F.explode(cells).alias("label")).filter("label <> ''")
    counts = held.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") < df.count())
    codes = sampling.with_position(counts.select("label"), [F.col("label")], name="code").withColumn("code", (F.col("code") - 1).cast("int"))
    coded = held.join(codes, "label").groupBy(key).agg(F.sort_array(F.collect_set("code")).alias("y"))
    return df.select(key).join(coded, key, "left").select(key, F.coalesce("y", F.array().cast("array<int>")).alias("y")), codes


def evaluate_text_multilabel(df: DataFrame, text: Column, labels: str | Sequence[str], key: str, min_df: int = 1, balance: bool = False,
                             auxiliary: Sequence[str] = (), categories: Sequence[str] = (), terms: str = "word",
                             max_terms: int = tfidf.MAX_TERMS, spec: CleanSpec = BESIDE_TEXT) -> DataFrame:
    """(model, metric, value): a binary model per non-constant label, all labels fitted together; ``labels`` as in
    label_places. Auxiliary columns are fused as in evaluate_text."""
    truth, codes = label_places(df, labels, key)
    truth, n_labels = truth.persist(), codes.count()
    if not n_labels:
        raise ValueError("no label that some but not all rows have")
    rows = sampling.stratified_holdout(df.withColumn("_text", text), None, key).join(truth, key).persist()
    train, test = text_features(rows.filter("NOT is_test"), rows.filter("is_test"), TERMS[terms](F.col("_text")), min_df, max_terms, auxiliary, categories, spec)
    columns = (train.select(F.col("features")).first() or [np.zeros(0)])[0].size
    tr, te = (x.select(key, "y", *sparse_parts("features")) for x in (train, test))

    def one(name: str, loss: str) -> DataFrame:
        pred = linear.fit(tr, columns, n_labels, loss, balance=balance, tolerance=1e-3).predict(te, key)
        return metrics.label_set_metrics(pred.join(truth, key), n_labels).withColumn("model", F.lit(name))

    losses = (("tfidf_ovr_logistic_regression", "logistic"), ("tfidf_ovr_linear_svc", "squared_hinge"))
    with ThreadPool(len(losses)) as pool:
        parts = pool.starmap(inheritable_thread_target(df.sparkSession)(one), losses, 1)
    return _union(parts).select("model", "metric", "value")


def topics(df: DataFrame, terms: Column, key: str, n_topics: int, min_df: int = 2, max_terms: int = tfidf.MAX_TERMS, top: int = 10,
           carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents with weights, topic and share, top terms per topic). Every document is part of the fit."""
    rows = df.select(key, *carry, terms.alias("terms"))
    model, made = tfidf.TfidfVectors("terms", "features", min_df, max_terms).fit_transform(rows)
    names = model.stages[0].vocabulary
    sparse = made.select(key, *carry, *sparse_parts("features"))
    found = topic_models.fit(sparse, n_topics, len(names), SEED)
    docs = found.transform(sparse, key, carry=carry)
    most = F.array_max("weights")
    docs = docs.withColumn("topic", (F.array_position("weights", most) - 1).cast("int"))
    docs = docs.withColumn("share", most / F.greatest(F.aggregate("weights", F.lit(0.0), lambda s, v: s + v), F.lit(1e-12)))
    best = [(t, r, names[i], float(h[i])) for t, h in enumerate(found.h) for r, i in enumerate(np.lexsort((names, -h))[:top], 1)]
    return docs, df.sparkSession.createDataFrame(best, "topic int, rank int, term string, weight double")


def evaluate_topics(df: DataFrame, terms: Column, key: str, label: str | None = None, min_df: int = 2) -> DataFrame:
    """Coherence proxy, topic diversity, silhouette of the topic weights and, with a label, NMI and ARI."""
    n = df.count()
    k = min(max(2, int(n**0.5)), 10, max(n - 1, 2))
    docs, top = topics(df, terms, key, k, min_df, carry=[label] if label else [])
    docs = docs.persist()
    out = docs.agg(metrics.clamp01(F.avg("share")).alias("value")).select(F.lit("coherence").alias("metric"), "value").unionByName(
        top.agg((F.count_distinct("term") / F.count("*")).alias("value")).select(F.lit("topic_diversity").alias("metric"), "value"))
    out = out.unionByName(topic_models.silhouette(docs, "weights", "topic", k))
    return out.unionByName(metrics.cluster_agreement(docs, label, "topic")) if label else out


def evaluate_vectors(df: DataFrame, vec: str, target: str, key: str, models: Callable[[int, int], dict] | None = None, scale: bool = False) -> DataFrame:
    """(model, metric, value): k-fold classification on an embedding column; ``scale`` standardises per training fold."""
    rows, names = indexed(df, target)
    k = sampling.fold_count(rows, "label")
    rows = sampling.stratified_folds(rows, "label", [sampling.shuffle_key(key), F.col(key)], k).withColumn("features", array_to_vector(F.col(vec))).persist()
    d = vectors.dimension(df, vec)
    made = models(d, len(names)) if models else {"logreg": LogisticRegression(maxIter=50, labelCol="label")}
    parts = []
    for f in range(k):
        train, test = rows.filter(F.col("fold") != f), rows.filter(F.col("fold") == f)
        if scale:
            scaler = StandardScaler(inputCol="features", outputCol="_s", withMean=True).fit(train)
            train, test = (scaler.transform(x).drop("features").withColumnRenamed("_s", "features") for x in (train, test))
        for name, est in made.items():
            parts.append(_predict(name, est.fit(train), test, f, "vectors"))
    long = metrics.multiclass_metrics(_union(parts), ["model", "fold"])
    return long.groupBy("model", "metric").agg(F.avg("value").alias("value"))


def evaluate_vectors_multilabel(df: DataFrame, vec: str, labels: str | Sequence[str], key: str, folds: int = 5) -> DataFrame:
    """Logistic models for all labels together on an embedding column, hashed folds; (metric, value)."""
    truth, codes = label_places(df, labels, key)
    truth, n_labels, d = truth.persist(), codes.count(), vectors.dimension(df, vec)
    values = F.transform(F.col(vec), lambda v: v.cast("double"))
    rows = sampling.hashed_folds(df.select(key, F.sequence(F.lit(0), F.size(vec) - 1).alias("indices"), values.alias("values")), key, folds).join(truth, key).persist()
    parts = []
    for f in range(folds):
        model = linear.fit(rows.filter(F.col("fold") != f), d, n_labels, tolerance=1e-4)
        parts.append(model.predict(rows.filter(F.col("fold") == f), key).withColumn("fold", F.lit(f)))
    long = metrics.label_set_metrics(_union(parts).join(truth, key), n_labels, ["fold"])
    return long.groupBy("metric").agg(F.avg("value").alias("value"))
