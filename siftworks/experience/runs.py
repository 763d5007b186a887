"""Evaluated results and the table of past runs: selection, reports, similarity search, append without repeats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import with_position

# Similarity and score thresholds, schema version, feature terms and weights per modality.
SIMILARITY = {"tabular": 0.60, "image": 0.60, "audio": 0.60, "text": 0.58}
GOOD_SCORE = 0.60
TOP_RUNS = 3
SCHEMA_VERSION = 4
CAP_20 = "least({v}, 20.0) / 20.0"
FEATURES: dict[str, dict[str, tuple[str, float]]] = {
    "tabular": {
        "missing_ratio": ("{v}", 1 / 3), "imbalance_ratio": (CAP_20, 1 / 3), "num_col_ratio": ("{v}", 0.5 / 3), "cat_col_ratio": ("{v}", 0.5 / 3)},
    "image": {
        "imbalance_ratio": (CAP_20, 1 / 3), "avg_brightness": ("{v}", 1 / 3), "avg_contrast": ("{v}", 1 / 3), "grayscale_ratio": ("{v}", 0.5 / 3)},
    "audio": {c: (e, 1 / 9) for c, e in {
        "n_audio_files": "least(log10(greatest({v}, 1)) / 6.0, 1.0)", "avg_duration_sec": "least({v} / 120.0, 1.0)",
        "duration_std_sec": "least({v} / 120.0, 1.0)", "silence_ratio": "{v}", "clipping_ratio": "{v}", "corruption_ratio": "{v}",
        "estimated_noise_ratio": "{v}", "imbalance_ratio": CAP_20, "n_classes": "least({v}, 100.0) / 100.0"}.items()},
    "text": {c: (e, 1 / 24) for c, e in {
        "n_samples": "least(log10(greatest({v}, 1)) / 6.0, 1.0)", "avg_token_length": "least({v} / 1000.0, 1.0)",
        "token_length_std": "least({v} / 1000.0, 1.0)", "vocabulary_size": "least(log10(greatest({v}, 1)) / 6.0, 1.0)",
        "duplicate_ratio": "{v}", "empty_text_ratio": "{v}", "noise_ratio": "{v}", "n_classes": "least({v}, 200.0) / 200.0",
        "imbalance_ratio": "least({v}, 50.0) / 50.0", "annotation_invalid_ratio": "{v}", "source_target_length_ratio": "least({v}, 5.0) / 5.0",
        "has_tabular_features": "{v}", "num_extra_numeric_cols": "least({v}, 50.0) / 50.0", "num_extra_categorical_cols": "least({v}, 50.0) / 50.0",
        "has_labels": "{v}", "has_multilabels": "{v}", "has_entity_annotations": "{v}", "has_pos_tags": "{v}", "has_relation_labels": "{v}",
        "has_similarity_pairs": "{v}", "has_summaries": "{v}", "has_qa_fields": "{v}", "has_generation_references": "{v}", "is_plain_corpus": "{v}",
    }.items()},
}


def similarity(current: Mapping, kind: str) -> Column:
    """1 minus the weighted distance of a run's profile columns to the current profile (a dict of plain values)."""
    total = F.lit(0.0)
    for name, (expr, weight) in FEATURES[kind].items():
        run, now = (F.expr(expr.replace("{v}", f"cast({v} AS double)")) for v in (name, repr(float(current[name]))))
        total = total + F.abs(run - now) * weight
    return F.greatest(F.lit(0.0), 1 - total)


def similar_runs(runs: DataFrame, current: Mapping, kind: str, metric: str, family: str, top: int = TOP_RUNS) -> DataFrame:
    """The most similar runs with the same metric and task family, similarity first, then score. One scan and a top-k."""
    scored = runs.filter((F.col("metric") == metric) & (F.col("family") == family)).withColumn("similarity", similarity(current, kind))
    near = scored.filter(F.col("similarity") >= SIMILARITY[kind])
    return near.orderBy(F.desc("similarity"), F.desc("score"), "run_id").limit(top)


def good_and_bad_runs(runs: DataFrame, current: Mapping, kind: str, metric: str, family: str, top: int = TOP_RUNS) -> DataFrame:
    """Top similar runs of each quality: ``good`` from a score of 0.60 on, ``bad`` below."""
    good = similar_runs(runs.filter(F.col("score") >= GOOD_SCORE), current, kind, metric, family, top).withColumn("quality", F.lit("good"))
    bad = similar_runs(runs.filter(F.col("score") < GOOD_SCORE), current, kind, metric, family, top).withColumn("quality", F.lit("bad"))
    return good.unionByName(bad)


def best_results(results: DataFrame, key: str = "dataset") -> DataFrame:
    """Best result per dataset: score descending, complexity ascending, time ascending, then spec."""
    rest = [c for c in results.columns if c != key]
    order = F.struct(-F.col("score"), F.col("complexity"), F.col("elapsed"), F.col("spec_id"))
    return results.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("b")).select(key, "b.*")


def ranked_results(results: DataFrame, key: str = "dataset") -> DataFrame:
    """Results numbered by score within a dataset."""
    return with_position(results, [F.desc("score"), F.col("complexity"), F.col("elapsed"), F.col("spec_id")], [key], "rank")


def failed_as_zero(results: DataFrame) -> DataFrame:
    """Failed evaluations stay in the table with score 0 and their reason."""
    return results.withColumn("score", F.when(F.col("success"), F.col("score")).otherwise(F.lit(0.0)))


def reports(results: DataFrame, summaries: DataFrame, key: str = "dataset") -> DataFrame:
    """(key, report): ranked results, the best one and the profile summary as JSON, one row per dataset. A dataset has at
    most as many results as its candidate cap, so its list is short."""
    ranked = ranked_results(results, key)
    fields = [c for c in ranked.columns if c not in (key, "rank")]
    lists = ranked.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("results"), F.count("*").alias("n_tested"))
    doc = lists.withColumn("best", F.col("results")[0]).join(summaries.select(key, F.struct(*[c for c in summaries.columns if c != key]).alias("profile")), key, "left")
    return doc.select(key, F.to_json(F.struct("profile", "n_tested", "results", "best")).alias("report"))


def write_reports(df: DataFrame, path: str) -> None:
    df.withColumn("timestamp", F.current_timestamp()).write.mode("append").json(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All reports, newest first. Reports written together share their time, so the other columns go on ordering them:
    by time alone, all of them would be sorted in one task."""
    found = spark.read.json(path)
    return found.orderBy(F.desc("timestamp"), *[c for c in found.columns if c not in ("timestamp", "report")])


def fingerprint(cols: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def new_runs(incoming: DataFrame, past: DataFrame | None, cols: Sequence[str]) -> DataFrame:
    """Incoming runs whose fingerprint occurs neither in the table nor earlier in the batch."""
    marked = incoming.withColumn("fingerprint", fingerprint(cols))
    rest = [c for c in incoming.columns]
    once = marked.groupBy("fingerprint").agg(F.min_by(F.struct(*rest), "run_id").alias("r")).select("fingerprint", "r.*")
    return once if past is None else once.join(past.select("fingerprint"), "fingerprint", "left_anti")


def append_runs(incoming: DataFrame, path: str, cols: Sequence[str]) -> DataFrame:
    """Appends new runs to the Parquet table of the current schema version and returns what was added."""
    spark = incoming.sparkSession
    target = f"{path}/v{SCHEMA_VERSION}"
    try:
        past = spark.read.parquet(target)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        past = None
    from ..session import cut_lineage

    added = cut_lineage(new_runs(incoming, past, cols))
    added.write.mode("append").parquet(target)
    return added
