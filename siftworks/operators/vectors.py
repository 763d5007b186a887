"""Evaluation on embedding columns: retrieval, verification, centroid identification, cluster indices, anomaly scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pairwise
from .metrics import average_precision, binary_metrics, clamp01, long_metrics, multiclass_metrics, ratio, roc_auc, threshold_sweep
from .quantiles import exact_quantiles


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def dimension(df: DataFrame, vec: str) -> int:
    row = df.select(F.size(vec)).first()
    return row[0] if row else 0


def column_means(df: DataFrame, vec: str, d: int, group: Sequence[str] = ()) -> DataFrame:
    """Mean vector per group: one partial sum per dimension, no exploding."""
    aggs = [F.avg(F.col(vec)[i].cast("double")) for i in range(d)]
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.array(*aggs).alias("centre"))


def pair_scores(pairs: DataFrame, vectors: DataFrame, key: str, vec: str, a: str = "a", b: str = "b") -> DataFrame:
    """Cosine of the two vectors each pair names."""
    left = vectors.select(F.col(key).alias(a), F.col(vec).alias("_va"))
    right = vectors.select(F.col(key).alias(b), F.col(vec).alias("_vb"))
    both = pairs.join(left, a).join(right, b)
    return both.withColumn("score", cosine(F.col("_va"), F.col("_vb"))).drop("_va", "_vb")


def verification(scored: DataFrame, truth: str = "same", score: str = "score", steps: int = 60) -> DataFrame:
    """AUROC, best accuracy and equal error rates of pair scores over evenly spaced thresholds."""
    ends = scored.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    grid = np.linspace(ends["lo"], ends["hi"], steps).tolist()
    auc = roc_auc(scored, [], truth, score).withColumn("metric", F.lit("auroc"))
    return auc.unionByName(threshold_sweep(scored, grid, [], truth, score))


def retrieval_k(df: DataFrame, label: str) -> int:
    """min(max(median class size - 1, 10), n - 1), the median taken over rows."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n"))
    rows = sizes.groupBy("n").agg(F.sum("n").alias("w"))
    total = rows.agg(F.sum("w")).first()[0]
    per_row = sizes.select(F.percentile(F.col("n"), 0.5, F.col("n")).alias("m"), F.sum("n").alias("t")).first()
    return min(max(max(int(per_row["m"] - 1), 1), 10), max(total - 1, 1))


def retrieval_metrics(df: DataFrame, key: str, vec: str, label: str, k: int | None = None, **limits) -> DataFrame:
    """recall@k, precision@k, MAP and MRR of cosine ranking with the label as relevance."""
    k = k or retrieval_k(df, label)
    rows = pairwise.ranking_rows(df, key, vec, label, k, **limits)
    shown = F.least(F.lit(k), F.col("others"))
    return rows.agg(
        F.avg(F.col("hits") / F.greatest("relevant", F.lit(1))).alias("recall_at_k"),
        F.avg(ratio(F.col("hits"), shown)).alias("precision_at_k"),
        F.avg("ap").alias("map"), F.avg("rr").alias("mrr"))


MAX_CENTRE_VALUES = 20_000_000


def fold_centroids(df: DataFrame, vec: str, label: str, fold: str, k: int) -> tuple[dict, dict]:
    """Per test fold: column means and deviations of its training rows, and the standardised class centres."""
    d = dimension(df, vec)
    train = df.withColumn("_t", F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(k - 1)), F.col(fold))))
    stats = train.groupBy("_t").agg(
        F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(d)]).alias("m"),
        F.array(*[F.stddev_pop(F.col(vec)[i].cast("double")) for i in range(d)]).alias("s")).collect()
    n_labels = df.select(label).distinct().count()
    if n_labels * k * d > MAX_CENTRE_VALUES:
        raise ValueError(f"{n_labels} classes of {d} values in {k} folds do not fit one task; evaluate fewer classes at a time")
    scale = {r["_t"]: (np.array(r["m"]), np.where(np.array(r["s"]) > 0, r["s"], 1.0)) for r in stats}
    centres: dict = {}
    for r in column_means(train, vec, d, ["_t", label]).orderBy("_t", label).collect():
        m, s = scale[r["_t"]]
        names, rows = centres.setdefault(r["_t"], ([], []))
        names.append(r[label])
        rows.append((np.array(r["centre"]) - m) / s)
    return scale, centres


def centroid_predictions(df: DataFrame, key: str, vec: str, label: str, fold: str, k: int) -> DataFrame:
    """(key, fold, y, pred, scores): the class centre of the other folds with the largest cosine, and all cosines."""
    scale, centres = fold_centroids(df, vec, label, fold, k)
    kind, lk = df.schema[key].dataType.simpleString(), df.schema[label].dataType.simpleString()

    def classify(batches):
        for pdf in batches:
            out = []
            for f, part in pdf.groupby(fold):
                m, s = scale[f]
                names, rows = centres[f]
                x = (np.stack([np.asarray(v, dtype=float) for v in part[vec]]) - m) / s
                c = np.stack(rows)
                sim = x @ c.T / np.clip(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :], 1e-8, None)
                for i, (key_value, y) in enumerate(zip(part[key], part[label])):
                    out.append((key_value, f, y, names[int(sim[i].argmax())], [
                        {"same": int(names[j] == y), "score": float(sim[i, j])} for j in range(len(names))]))
            yield pd.DataFrame(out, columns=[key, "fold", "y", "pred", "scores"])

    schema = f"`{key}` {kind}, fold int, y {lk}, pred {lk}, scores array<struct<same:int,score:double>>"
    return df.select(key, vec, label, F.col(fold).cast("int").alias(fold)).mapInPandas(classify, schema)


def speaker_identification(df: DataFrame, key: str, vec: str, label: str, fold: str, k: int) -> DataFrame:
    """Fold-averaged identification metrics and the pooled verification metrics of all row/centre cosines."""
    pred = centroid_predictions(df, key, vec, label, fold, k).persist()
    ident = multiclass_metrics(pred, ["fold"]).filter("metric IN ('accuracy', 'macro_f1', 'weighted_f1')")
    ident = ident.groupBy("metric").agg(F.avg("value").alias("value"))
    pooled = pred.select(F.inline("scores"))
    return ident.unionByName(verification(pooled, "same", "score", 50))


def cluster_indices(df: DataFrame, vec: str, cluster: str, noise=-1) -> DataFrame:
    """Davies-Bouldin and Calinski-Harabasz from centres; noise rows are left out. Empty when fewer than two clusters."""
    kept = df.filter(F.col(cluster) != F.lit(noise))
    d = dimension(kept, vec)
    centres = column_means(kept, vec, d, [cluster])
    joined = kept.join(centres, cluster)
    sq = F.aggregate(F.zip_with(vec, "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    per = joined.groupBy(cluster).agg(F.avg(F.sqrt(sq)).alias("spread"), F.sum(sq).alias("within"))
    rows = centres.join(per, cluster).limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    if len(rows) < 2 or sum(r["n"] for r in rows) <= len(rows):
        return df.sparkSession.createDataFrame([], "metric string, value double")
    c = np.array([r["centre"] for r in rows])
    n = np.array([r["n"] for r in rows], dtype=float)
    s = np.array([r["spread"] for r in rows])
    gap = np.sqrt(((c[:, None, :] - c[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(gap, np.inf)
    similar = np.where(gap > 0, (s[:, None] + s[None, :]) / np.where(gap > 0, gap, 1.0), 0.0)
    np.fill_diagonal(similar, -np.inf)
    mean = (c * n[:, None]).sum(0) / n.sum()
    between = float((n * ((c - mean) ** 2).sum(1)).sum())
    within = float(sum(r["within"] for r in rows))
    k = len(rows)
    ch = 1.0 if within == 0 else between * (n.sum() - k) / (within * (k - 1))
    return df.sparkSession.createDataFrame(
        [("davies_bouldin_score", float(similar.max(1).mean())), ("calinski_harabasz_score", float(ch))], "metric string, value double")


MAX_CLUSTERS = 5000


def silhouette(df: DataFrame, key: str, vec: str, cluster: str, noise=-1, **limits) -> DataFrame:
    """Exact Euclidean silhouette from per-cluster distance sums."""
    kept = df.filter(F.col(cluster) != F.lit(noise))
    sums = pairwise.cluster_distance_sums(kept, key, vec, cluster, **limits)
    own = kept.select(key, F.col(cluster).alias("_own"))
    mean = F.when(F.col("cluster") == F.col("_own"), F.col("total") / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.col("total") / F.col("n"))
    per = sums.join(own, key).withColumn("m", mean).groupBy(key).agg(
        F.max(F.when(F.col("cluster") == F.col("_own"), F.col("m"))).alias("a"),
        F.min(F.when(F.col("cluster") != F.col("_own"), F.col("m"))).alias("b"),
        F.max(F.when(F.col("cluster") == F.col("_own"), F.col("n"))).alias("size"))
    value = F.when(F.col("size") == 1, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg(F.lit("silhouette_score").alias("metric"), F.avg(value).alias("value"))


def contamination(n: int, events: float = 5.0, low: float = 0.02, high: float = 0.15) -> float:
    return min(high, max(low, events / max(n, 1)))


def flag_top(scored: DataFrame, score: str, share: float, out: str = "pred") -> DataFrame:
    """1 for scores at or above the exact (1 - share) quantile."""
    cut = exact_quantiles(scored, [score], [1.0 - share])[score][0]
    return scored.withColumn(out, (F.col(score) >= F.lit(float(cut))).cast("int"))


def anomaly_proxy(scored: DataFrame, order: str, score: str = "score", pred: str = "pred") -> DataFrame:
    """Separation, contamination consistency, stability of the two halves along ``order`` and their weighted sum."""
    from .ordering import with_position

    pos = with_position(scored.select(order, score, pred), [F.col(order)], name="_p")
    n = scored.count()
    target = contamination(n)
    half = min(n, max(20, n // 2))
    hit = F.col(pred) == 1
    agg = pos.agg(
        F.avg(F.when(hit, F.col(score))).alias("out"), F.avg(F.when(~hit, F.col(score))).alias("inn"), F.stddev_pop(score).alias("sd"),
        F.avg(pred).alias("rate"), F.avg(F.when(F.col("_p") <= half, F.col(pred))).alias("ha"), F.avg(F.when(F.col("_p") > n - half, F.col(pred))).alias("hb"))
    spread = F.when(F.abs("sd") > 1e-12, F.col("sd")).otherwise(F.lit(1.0))
    sep = F.when(F.col("out").isNull() | F.col("inn").isNull(), F.lit(0.0)).otherwise(clamp01(0.5 + 0.5 * F.tanh((F.col("out") - F.col("inn")) / spread)))
    agg = agg.withColumns({
        "score_separation": sep,
        "contamination_consistency": clamp01(1 - F.abs(F.col("rate") - target) / max(target, 1e-6)),
        "stability": clamp01(1 - F.abs(F.col("ha") - F.col("hb"))) if half >= 10 else F.lit(0.5)})
    agg = agg.withColumn("proxy_score", clamp01(0.4 * F.col("score_separation") + 0.3 * F.col("stability") + 0.3 * F.col("contamination_consistency")))
    return long_metrics(agg, [], ["proxy_score", "score_separation", "stability", "contamination_consistency"])


def signal_anomaly_proxy(scored: DataFrame, order: str, z: str, centre: Column, score: str = "score", pred: str = "pred") -> DataFrame:
    """Proxies for signal features ``z`` (standardised): separation of the scores, stability of the two halves along
    ``order``, and how close the features lie to their medians ``centre``; weighted 0.4, 0.3 and 0.3."""
    from .ordering import with_position

    off = F.aggregate(F.zip_with(z, centre, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    pos = with_position(scored.select(order, score, pred, off.alias("_off"), F.size(z).alias("_d")), [F.col(order)], name="_p")
    n = scored.count()
    hit, half = F.col(pred) == 1, n // 2
    agg = pos.agg(
        F.avg(F.when(hit, F.col(score))).alias("out"), F.avg(F.when(~hit, F.col(score))).alias("inn"), F.stddev_pop(score).alias("sd"), (F.sum("_off") / F.sum("_d")).alias("off"),
        F.avg(F.when(F.col("_p") <= half, F.col(pred))).alias("ha"), F.avg(F.when(F.col("_p") > half, F.col(pred))).alias("hb"))
    apart = clamp01(0.5 + 0.5 * F.tanh((F.col("out") - F.col("inn")) / F.greatest("sd", F.lit(1e-6))))
    agg = agg.withColumns({
        "score_separation": F.when(F.col("out").isNull() | F.col("inn").isNull(), F.lit(0.0)).otherwise(apart),
        "reconstruction_consistency": clamp01(1 / (1 + F.col("off"))),
        "stability": clamp01(1 - F.abs(F.col("ha") - F.col("hb"))) if n >= 4 else F.lit(0.5)})
    agg = agg.withColumn("proxy_score", clamp01(0.4 * F.col("score_separation") + 0.3 * F.col("reconstruction_consistency") + 0.3 * F.col("stability")))
    return long_metrics(agg, [], ["proxy_score", "score_separation", "reconstruction_consistency", "stability"])


def signal_anomaly(df: DataFrame, key: str, vec: str, truth: Column | None = None) -> DataFrame:
    """(model, metric, value) of PCA reconstruction and of the distance from the medians, both on standardised features;
    supervised with a 0/1 truth, else by proxies. At least 8 rows."""
    rows = standardized(df.withColumn("y", truth.cast("int")) if truth is not None else df, vec, "_z").persist()
    n, d = rows.count(), dimension(rows, "_z")
    if n < 8:
        raise ValueError("signal anomalies need at least 8 rows")
    centre = medians(rows, "_z")
    found = {
        "pca_reconstruction": pca_reconstruction(rows, "_z", max(1, min(d - 1, n - 1, max(2, d // 3)))),
        "distance_from_normal": distance_from_median(rows, "_z", centre),
    }
    out = None
    for name, scored in found.items():
        flagged = flag_top(scored.persist(), "score", contamination(n, 3.0, 0.02, 0.2))
        m = anomaly_supervised(flagged, "y") if truth is not None else signal_anomaly_proxy(flagged, key, "_z", centre)
        m = m.select(F.lit(name).alias("model"), "metric", "value")
        out = m if out is None else out.unionByName(m)
    return out


def image_anomaly_proxy(scored: DataFrame, score: str = "score", pred: str = "pred") -> DataFrame:
    """Proxies for images: separation of the scores and agreement with the expected share of anomalies, weighted 0.6 and
    0.4; they stand in for recall and precision, their sum for F1."""
    hit = F.col(pred) == 1
    agg = scored.agg(
        F.avg(F.when(hit, F.col(score))).alias("out"), F.avg(F.when(~hit, F.col(score))).alias("inn"), F.stddev_pop(score).alias("sd"),
        F.avg(F.col(pred).cast("double")).alias("rate"), F.count("*").alias("n"))
    spread = F.when(F.abs("sd") > 1e-12, F.col("sd")).otherwise(F.lit(1.0))
    target = F.least(F.lit(0.15), F.greatest(F.lit(0.02), F.lit(5.0) / F.greatest("n", F.lit(1))))
    agg = agg.withColumn("recall", F.when(F.col("out").isNull() | F.col("inn").isNull(), F.lit(0.0)).otherwise(clamp01(0.5 + 0.5 * F.tanh((F.col("out") - F.col("inn")) / spread))))
    agg = agg.withColumn("precision", clamp01(1 - F.abs(F.col("rate") - target) / target))
    agg = agg.withColumn("proxy_score", clamp01(0.6 * F.col("recall") + 0.4 * F.col("precision"))).withColumn("f1", F.col("proxy_score"))
    return long_metrics(agg, [], ["proxy_score", "precision", "recall", "f1"])


def anomaly_supervised(scored: DataFrame, y: str, score: str = "score", pred: str = "pred") -> DataFrame:
    """F1, precision, recall, AUROC and AUPRC against 0/1 labels that travel with the rows."""
    base = binary_metrics(scored, [], 1, y, pred).filter("metric <> 'accuracy'")
    auc = roc_auc(scored, [], y, score).withColumn("metric", F.lit("auroc"))
    return base.unionByName(auc).unionByName(average_precision(scored, [], y, score))


def standardized(df: DataFrame, vec: str, out: str = "z") -> DataFrame:
    """Every dimension centred and divided by its population deviation."""
    d = dimension(df, vec)
    row = df.agg(*[F.struct(F.avg(F.col(vec)[i].cast("double")).alias("m"), F.stddev_pop(F.col(vec)[i].cast("double")).alias("s")).alias(f"c{i}") for i in range(d)]).first()
    m = F.array(*[F.lit(float(row[f"c{i}"]["m"])) for i in range(d)])
    s = F.array(*[F.lit(float(row[f"c{i}"]["s"] or 1.0)) for i in range(d)])
    return df.withColumn(out, F.zip_with(F.zip_with(F.col(vec), m, lambda a, b: a - b), s, lambda a, b: a / b))


def medians(df: DataFrame, vec: str) -> Column:
    """The vector of exact column medians, as a literal."""
    flat = df.select(*[F.col(vec)[i].alias(f"c{i}") for i in range(dimension(df, vec))])
    med = exact_quantiles(flat, flat.columns, [0.5])
    return F.array(*[F.lit(float(med[c][0])) for c in flat.columns])


def distance_from_median(df: DataFrame, vec: str, centre: Column | None = None) -> DataFrame:
    """``score``: Euclidean distance to the vector of exact column medians."""
    diff = F.zip_with(F.col(vec), medians(df, vec) if centre is None else centre, lambda a, b: (a - b) * (a - b))
    return df.withColumn("score", F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, v: s + v)))


def pca_reconstruction(df: DataFrame, vec: str, components: int) -> DataFrame:
    """``score``: mean squared error after projection on the leading components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = dimension(df, vec)
    mean = df.agg(*[F.avg(F.col(vec)[i].cast("double")).alias(f"c{i}") for i in range(d)]).first()
    centre = F.array(*[F.lit(float(mean[f"c{i}"])) for i in range(d)])
    centred = df.withColumn("_c", F.zip_with(F.col(vec), centre, lambda a, b: a.cast("double") - b))
    model = PCA(k=components, inputCol="_v", outputCol="_p").fit(centred.withColumn("_v", array_to_vector("_c")))
    total = dot(F.col("_c"), F.col("_c"))
    projected = model.transform(centred.withColumn("_v", array_to_vector("_c"))).withColumn("_a", vector_to_array("_p"))
    # The components are orthonormal, so the error is what the projection leaves of the squared length.
    return projected.withColumn("score", F.greatest((total - dot(F.col("_a"), F.col("_a"))) / d, F.lit(0.0))).drop("_c", "_v", "_p", "_a")


def cluster_count(n: int) -> int:
    return max(2, min(8, round(math.sqrt(max(n, 4) / 2.0))))
