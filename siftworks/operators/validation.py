"""Dataset checks that return one row per violated rule; each check is a single aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Minimum sizes and the annotation each task needs.
MIN_ROWS, MIN_SERIES_ROWS, MIN_CLASSES, MIN_PER_CLASS = 10, 20, 2, 2
SUPERVISED = ("binary", "multiclass", "regression", "time_series")
NUMERIC_TARGET = ("regression", "time_series")
IMAGE_NEEDS = {"detection": "bboxes", "semantic_segmentation": "masks", "ocr": "transcription"}
AUDIO_NEEDS = {"asr": "transcript", "noise_suppression": "clean", "sound_event_detection": "event"}


def _errors(one_row: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    cells = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return one_row.select(F.explode(cells).alias("error"))


def check_table(df: DataFrame, target: str | None, task: str) -> DataFrame:
    features = [c for c in df.columns if c != target]
    aggs = [F.count("*").alias("n")]
    has_target = bool(target) and target in df.columns
    if has_target:
        # Two distinct values exist exactly when the extremes differ, which needs no distinct count.
        aggs += [F.count(target).alias("present"), (F.min(target) != F.max(target)).alias("varies")]
    row = df.agg(*aggs)
    rules = {"too_few_rows": F.col("n") < MIN_ROWS, "no_feature_columns": F.lit(not features)}
    if task in SUPERVISED:
        rules["target_missing"] = F.lit(not target)
        rules["target_not_found"] = F.lit(bool(target) and not has_target)
        if has_target:
            rules["target_all_null"] = F.col("present") == 0
            rules["target_single_value"] = (F.col("present") > 0) & ~F.col("varies")
            rules["target_not_numeric"] = F.lit(task in NUMERIC_TARGET and not isinstance(df.schema[target].dataType, T.NumericType))
    if task == "time_series":
        rules["too_few_rows_for_series"] = F.col("n") < MIN_SERIES_ROWS
    return _errors(row, rules)


def check_text(df: DataFrame, roles: Mapping[str, str], required: Sequence[str], valid: Column | None = None) -> DataFrame:
    """``roles`` maps a role to its column; ``valid`` marks rows with a usable annotation."""
    absent = [r for r in required if not roles.get(r)]
    unknown = [c for c in roles.values() if c and c not in df.columns]
    present = {r: c for r, c in roles.items() if c in df.columns}
    aggs = [F.count("*").alias("n")]
    aggs += [F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias(f"filled_{r}") for r, c in present.items()]
    if valid is not None:
        aggs.append(F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))
    rules = {"empty_dataset": F.col("n") == 0}
    rules.update({f"missing_role_{r}": F.lit(True) for r in absent})
    rules.update({f"unknown_column_{c}": F.lit(True) for c in unknown})
    rules.update({f"blank_column_{r}": (F.col("n") > 0) & (F.col(f"filled_{r}") == 0) for r in present})
    if valid is not None:
        rules["invalid_annotations"] = F.col("invalid") > 0
    return _errors(df.agg(*aggs), rules)


def check_samples(df: DataFrame, label: str, task: str, annotated: Column | None = None) -> DataFrame:
    """Image or audio samples: at least ten, two classes of two samples for classification, and the annotation the task
    needs (``annotated`` marks samples that carry it)."""
    flag = F.coalesce(annotated, F.lit(False)) if annotated is not None else F.lit(True)
    named = F.when(F.coalesce(F.trim(F.col(label)), F.lit("")) != "", F.col(label))
    per = df.groupBy(named.alias("_l")).agg(F.count("*").alias("n"), F.count_if(flag).alias("a"))
    row = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("_l").alias("classes"),
        F.min(F.when(F.col("_l").isNotNull(), F.col("n"))).alias("smallest"), F.coalesce(F.sum("a"), F.lit(0)).alias("annotated"))
    rules = {"too_few_samples": F.col("n") < MIN_ROWS}
    if task in ("classification", "multilabel", "retrieval"):
        rules["too_few_classes"] = F.col("classes") < MIN_CLASSES
        rules["class_too_small"] = F.col("smallest") < MIN_PER_CLASS
    if annotated is not None:
        rules["annotation_missing"] = F.col("annotated") == 0
    return _errors(row, rules)
