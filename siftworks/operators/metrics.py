"""Evaluation metrics as aggregations over a predictions table.

Every function takes grouping keys (spec, model, fold, ...) and returns a long table (keys, metric, value), so one
job scores all candidates at once. Labels and predictions meet in a confusion table first; what follows works on
one row per (keys, label, prediction).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import running_totals
from .rows import side_by_side


def long_metrics(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
    return df.select(*keys, F.inline(F.array(*cells)))


def ratio(num: Column, den: Column) -> Column:
    """0 instead of a division by zero."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f1_of(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def confusion(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*keys, y, pred).agg(F.count("*").alias("n"))


def binary_metrics(df: DataFrame, keys: Sequence[str], positive, y: str = "y", pred: str = "pred") -> DataFrame:
    t, p = F.col(y) == F.lit(positive), F.col(pred) == F.lit(positive)
    agg = df.groupBy(*keys).agg(
        F.avg((F.col(y) == F.col(pred)).cast("int")).alias("accuracy"),
        F.count_if(t & p).alias("tp"),
        F.count_if(p).alias("pp"),
        F.count_if(t).alias("ap"),
    )
    agg = agg.withColumn("precision", ratio(F.col("tp"), F.col("pp"))).withColumn("recall", ratio(F.col("tp"), F.col("ap")))
    agg = agg.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))
    return long_metrics(agg, keys, ["accuracy", "f1", "precision", "recall"])


def per_class_scores(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of every label that occurs as truth or prediction."""
    cells = confusion(df, keys, y, pred)
    sides = cells.select(*keys, F.inline(F.array(
        F.struct(F.col(y).alias("label"), F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("tp"),
                 F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )))
    per = sides.groupBy(*keys, "label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    per = per.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return per.withColumn("f1", f1_of(F.col("precision"), F.col("recall")))


def multiclass_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    per = per_class_scores(df, keys, y, pred)
    agg = per.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
    )
    return long_metrics(agg, keys, ["accuracy", "macro_f1", "weighted_f1", "macro_precision", "macro_recall"])


def multilabel_metrics(df: DataFrame, labels: Mapping[str, tuple[str, str]], keys: Sequence[str] = ()) -> DataFrame:
    """``labels`` maps a label to its 0/1 truth and prediction columns; one pass over the rows."""
    tp = sum((F.col(t) * F.col(p)).cast("long") for t, p in labels.values())
    pp = sum(F.col(p).cast("long") for _, p in labels.values())
    ap = sum(F.col(t).cast("long") for t, _ in labels.values())
    wrong = sum((F.col(t) != F.col(p)).cast("long") for t, p in labels.values())
    per = []
    for i, (t, p) in enumerate(labels.values()):
        per += [F.sum(F.col(t) * F.col(p)).alias(f"tp{i}"), F.sum(F.col(p)).alias(f"pp{i}"), F.sum(F.col(t)).alias(f"ap{i}")]
    agg = df.groupBy(*keys).agg(
        F.sum(tp).alias("tp"), F.sum(pp).alias("pp"), F.sum(ap).alias("ap"),
        (F.sum(wrong) / (F.count("*") * len(labels))).alias("hamming_loss"),
        F.avg((wrong == 0).cast("int")).alias("subset_accuracy"), *per,
    )
    agg = agg.withColumn("precision", ratio(F.col("tp"), F.col("pp"))).withColumn("recall", ratio(F.col("tp"), F.col("ap")))
    agg = agg.withColumn("micro_f1", f1_of(F.col("precision"), F.col("recall")))
    macro = sum(ratio(2.0 * F.col(f"tp{i}"), F.col(f"pp{i}") + F.col(f"ap{i}")) for i in range(len(labels))) / len(labels)
    agg = agg.withColumn("macro_f1", macro)
    return long_metrics(agg, keys, ["micro_f1", "macro_f1", "hamming_loss", "subset_accuracy", "precision", "recall"])


def label_set_metrics(df: DataFrame, n_labels: int, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """The metrics of multilabel_metrics for rows that carry their true and predicted labels as arrays of codes. Only
    labels that a row has or is given are counted, so their number costs nothing."""
    both = df.select(*keys, y, pred, F.size(F.array_intersect(y, pred)).alias("_tp"))
    wrong = F.size(y) + F.size(pred) - 2 * F.col("_tp")
    agg = both.groupBy(*keys).agg(
        F.sum("_tp").alias("tp"), F.sum(F.size(pred)).alias("pp"), F.sum(F.size(y)).alias("ap"),
        (F.sum(wrong) / (F.count("*") * n_labels)).alias("hamming_loss"), F.avg((wrong == 0).cast("int")).alias("subset_accuracy"))
    agg = agg.withColumn("precision", ratio(F.col("tp"), F.col("pp"))).withColumn("recall", ratio(F.col("tp"), F.col("ap")))
    agg = agg.withColumn("micro_f1", f1_of(F.col("precision"), F.col("recall")))
    marks = F.concat(F.transform(y, lambda v: F.struct(v.alias("l"), F.lit(1).alias("t"), F.lit(0).alias("p"))), F.transform(pred, lambda v: F.struct(v.alias("l"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    hits = F.concat(F.transform(F.array_intersect(y, pred), lambda v: F.struct(v.alias("l"), F.lit(0).alias("t"), F.lit(0).alias("p"), F.lit(1).alias("h"))), F.transform(marks, lambda m: F.struct(m["l"].alias("l"), m["t"].alias("t"), m["p"].alias("p"), F.lit(0).alias("h"))))
    per = df.select(*keys, F.inline(hits)).groupBy(*keys, "l").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    macro = per.groupBy(*keys).agg((F.sum(2.0 * F.col("h") / (F.col("t") + F.col("p"))) / n_labels).alias("macro_f1"))
    if keys:
        return long_metrics(agg.join(macro, list(keys), "left").fillna(0.0, ["macro_f1"]), keys, ["micro_f1", "macro_f1", "hamming_loss", "subset_accuracy", "precision", "recall"])
    return long_metrics(agg, [], ["micro_f1", "hamming_loss", "subset_accuracy", "precision", "recall"]).unionByName(long_metrics(macro.fillna(0.0), [], ["macro_f1"]))


def regression_metrics(df: DataFrame, keys: Sequence[str] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """MAE, RMSE, R2 (0 without variance), SMAPE and MAPE in percent."""
    t, p = F.col(y).cast("double"), F.col(pred).cast("double")
    both = F.abs(t) + F.abs(p)
    smape = 2 * F.abs(p - t) / F.when(both <= 1e-12, F.lit(1.0)).otherwise(both)
    mape = F.when(F.abs(t) > 1e-12, F.abs((t - p) / t))
    ss_tot = F.var_pop(t) * F.count(t)
    agg = df.groupBy(*keys).agg(
        F.avg(F.abs(t - p)).alias("mae"),
        F.sqrt(F.avg((t - p) * (t - p))).alias("rmse"),
        F.when(ss_tot > 1e-12, 1 - F.sum((t - p) * (t - p)) / ss_tot).otherwise(F.lit(0.0)).alias("r2"),
        (F.avg(smape) * 100).alias("smape"),
        F.coalesce(F.avg(mape) * 100, F.lit(0.0)).alias("mape"),
    )
    return long_metrics(agg, keys, ["mae", "rmse", "r2", "smape", "mape"])


def _score_counts(df: DataFrame, keys: Sequence[str], y: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: the only thing rank metrics need."""
    return df.groupBy(*keys, score).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, keys: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """Rank-sum AUC with ties counted half."""
    counts = running_totals(_score_counts(df, keys, y, score), [F.col(score)], {"neg_cum": F.col("neg")}, keys)
    agg = counts.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") / 2.0)).alias("u"),
        F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"),
    ).filter((F.col("p") > 0) & (F.col("n") > 0))
    return long_metrics(agg.withColumn("roc_auc", F.col("u") / (F.col("p") * F.col("n"))), keys, ["roc_auc"])


def average_precision(df: DataFrame, keys: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """Area under precision-recall as a step sum over distinct scores, highest first."""
    counts = running_totals(
        _score_counts(df, keys, y, score), [F.col(score).desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, keys)
    agg = counts.groupBy(*keys).agg(
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("hit"), F.sum("pos").alias("p"))
    return long_metrics(agg.withColumn("auprc", ratio(F.col("hit"), F.col("p"))), keys, ["auprc"])


def threshold_sweep(df: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = (), y: str = "y", score: str = "score") -> DataFrame:
    """Best accuracy and the smallest (FP+FN)/2 as a share of all rows over the thresholds, plus the per-class equal
    error rate. Rows are first counted per interval between thresholds; the sweep runs on those few rows."""
    from pyspark.ml.feature import Bucketizer

    cuts = sorted(set(float(t) for t in thresholds))
    binned = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_s", outputCol="_b").transform(
        df.withColumn("_s", F.col(score).cast("double")))
    cells = binned.groupBy(*keys, "_b").agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    swept = cells.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1)))).groupBy(*keys, "_t").agg(
        F.sum(F.when(F.col("_b") > F.col("_t"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("_b") <= F.col("_t"), F.col("pos")).otherwise(0)).alias("fn"),
        F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    wrong = (F.col("fp") + F.col("fn")) / (F.col("p") + F.col("q"))
    far, frr = ratio(F.col("fp"), F.col("q")), ratio(F.col("fn"), F.col("p"))
    best = F.min(F.struct(F.abs(far - frr).alias("gap"), ((far + frr) / 2).alias("eer")))
    agg = swept.groupBy(*keys).agg(
        (1 - F.min(wrong)).alias("verification_accuracy"), (F.min(wrong) / 2).alias("eer_share"), best["eer"].alias("eer"))
    return long_metrics(agg, keys, ["verification_accuracy", "eer_share", "eer"])


def average_ranks(df: DataFrame, col: str, name: str) -> DataFrame:
    """(value, rank) with ties sharing their average rank; ranked on distinct values only."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("_n"))
    cum = running_totals(counts, [F.col(col)], {"_cum": F.col("_n")})
    return cum.select(col, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(name))


def correlation_metrics(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman in one long table."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("_w"))
    ranked = pairs.join(average_ranks(df, a, "_ra"), a).join(average_ranks(df, b, "_rb"), b)

    def weighted(x, y):
        w = F.col("_w")
        sx, sy = F.sum(w * x) / F.sum(w), F.sum(w * y) / F.sum(w)
        cov = F.sum(w * x * y) / F.sum(w) - sx * sy
        vx, vy = F.sum(w * x * x) / F.sum(w) - sx * sx, F.sum(w * y * y) / F.sum(w) - sy * sy
        return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).otherwise(F.lit(0.0))

    pearson = df.agg(F.coalesce(F.nanvl(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0)), F.lit(0.0)).alias("value"))
    spearman = ranked.agg(weighted(F.col("_ra"), F.col("_rb")).alias("value"))
    return pearson.select(F.lit("pearson").alias("metric"), "value").union(
        spearman.select(F.lit("spearman").alias("metric"), "value"))


def error_scales(df: DataFrame, y: str) -> DataFrame:
    """Deviation, range and mean magnitude of a target and the scale used to normalise MAE and RMSE."""
    t = F.col(y).cast("double")
    agg = df.agg(F.stddev_pop(t).alias("s"), (F.max(t) - F.min(t)).alias("r"), F.avg(F.abs(t)).alias("m"))

    def safe(c, fallback):
        return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) > 1e-12), F.abs(c)).otherwise(fallback)

    agg = agg.withColumn("std", safe(F.col("s"), F.lit(1.0)))
    agg = agg.withColumn("range", safe(F.col("r"), F.col("std"))).withColumn("mean_abs", safe(F.col("m"), F.col("std")))
    return agg.withColumn("error_scale", F.greatest("std", F.col("range") / 4, F.lit(1.0))).drop("s", "r", "m")


# Which formula maps each metric to [0, 1].
ERROR_METRICS = ("mae", "rmse")
PERCENT_METRICS = ("smape", "mape")
SIGNED_METRICS = ("r2", "silhouette_score", "silhouette", "spearman", "pearson", "ari")
RATE_METRICS = ("hamming_loss", "cer", "wer", "eer_share", "eer")


def clamp01(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def normalized(metric: Column, value: Column, scale: Column | None = None) -> Column:
    """Metric value as a score in [0, 1], larger is better."""
    pos = F.greatest(value, F.lit(0.0))
    scale = F.lit(1.0) if scale is None else scale
    expr = (
        F.when(metric.isin(*ERROR_METRICS), 1 / (1 + pos / scale))
        .when(metric.isin(*PERCENT_METRICS), 1 - F.least(value, F.lit(200.0)) / 200)
        .when(metric.isin(*SIGNED_METRICS), (value + 1) / 2)
        .when(metric.isin(*RATE_METRICS), 1 - F.least(value, F.lit(1.0)))
        .when(metric == "davies_bouldin_score", 1 / (1 + pos))
        .when(metric == "calinski_harabasz_score", F.log1p(pos) / (1 + F.log1p(pos)))
        .when(metric == "lift", F.when(value > 0, value / (value + 1)).otherwise(F.lit(0.0)))
        .when(metric == "number_of_rules", 1 - F.exp(-value / 20))
        .otherwise(value)
    )
    return clamp01(expr)


def across_models(long: DataFrame, spec: Sequence[str] = (), model: str = "model") -> DataFrame:
    """Mean over folds per model, then mean and population deviation over models; non-finite values are skipped."""
    v = F.col("value")
    finite = long.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    per_model = finite.groupBy(*spec, model, "metric").agg(F.avg("value").alias("value"))
    return per_model.groupBy(*spec, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def selected_metric(available: DataFrame, requested: str, fallback: str) -> DataFrame:
    """The requested metric when it is there, else the fallback, else the first by name; one row."""
    pick = F.coalesce(
        F.max(F.when(F.col("metric") == requested, F.col("metric"))),
        F.max(F.when(F.col("metric") == fallback, F.col("metric"))),
        F.min("metric"),
    )
    return available.agg(pick.alias("metric")).withColumn("fell_back", F.col("metric") != requested)


def cluster_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """NMI (arithmetic mean) and ARI from the contingency table."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("nb"))
    joint = cells.join(rows, a).join(cols, b)
    total = F.lit(float(df.count()))

    def comb2(x):
        return x * (x - 1) / 2

    j = joint.agg(
        F.sum(F.col("n") / total * F.log(F.col("n") * total / (F.col("na") * F.col("nb")))).alias("mi"),
        F.sum(comb2(F.col("n"))).alias("idx"),
    )
    ha = rows.agg((-F.sum(F.col("na") / total * F.log(F.col("na") / total))).alias("ha"), F.sum(comb2(F.col("na"))).alias("sa"))
    hb = cols.agg((-F.sum(F.col("nb") / total * F.log(F.col("nb") / total))).alias("hb"), F.sum(comb2(F.col("nb"))).alias("sb"))
    out = side_by_side(j, ha, hb)
    mean_h = (F.col("ha") + F.col("hb")) / 2
    expected = F.col("sa") * F.col("sb") / comb2(total)
    top = (F.col("sa") + F.col("sb")) / 2
    out = out.withColumn("nmi", F.when(mean_h > 0, F.col("mi") / mean_h).otherwise(F.lit(1.0)))
    out = out.withColumn("ari", F.when(top != expected, (F.col("idx") - expected) / (top - expected)).otherwise(F.lit(1.0)))
    return long_metrics(out, [], ["nmi", "ari"])
