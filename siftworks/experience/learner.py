"""Learning from past runs: numeric encoding of (context, profile, spec), a forest over it, advisory re-ranking."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Order of the codes, weights and limits of the learner.
TASKS = {
    "tabular": ("binary", "multiclass", "regression", "time_series", "clustering", "anomaly", "association_rules", "other"),
    "text": ("classification_single", "classification_multi", "ner", "semantic_similarity", "summarization", "question_answering", "topic_modeling", "other"),
    "image": ("classification", "multilabel", "detection", "semantic_segmentation", "retrieval", "anomaly", "ocr", "other"),
    "audio": ("classification", "asr", "speaker_recognition", "sound_event_detection", "vad", "anomaly", "noise_suppression", "other"),
}
FORMATS = {
    "tabular": ("csv_excel", "json_records", "xml_records", "yaml_records"),
    "text": ("csv_excel", "json_text_records", "txt_zip", "other"),
    "image": ("zip_folder", "coco", "pascal_voc", "yolo"),
    "audio": ("zip_folder", "metadata_csv", "metadata_json"),
}
TASK_POSITION = {"binary": 0.0, "multiclass": 0.15, "regression": 0.35, "time_series": 0.5, "clustering": 0.65, "anomaly": 0.8, "association_rules": 1.0}
BUDGETS = {"minimal": 0.0, "light": 0.33, "moderate": 0.67, "heavy": 1.0}
QUALITIES = {"clean": 0.0, "mostly_clean": 0.25, "mixed": 0.5, "unknown": 0.75, "noisy": 1.0}
FORMAT_WEIGHT, FLAG_WEIGHT = 0.05, 0.10
MIN_ROWS, FULL_ROWS, MAX_WEIGHT = 5, 20, 0.25
TREES, DEPTH, MIN_LEAF = 50, 6, 2


def coded(col: str, codes: dict[str, float], default: float) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in codes.items()) + f" ELSE {default!r} END"


def positions(names, scale: float = 1.0) -> dict[str, float]:
    return {n: scale * i / (len(names) - 1) for i, n in enumerate(names)}


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"


def _task(kind: str) -> str:
    return coded("task_type", positions(TASKS[kind]), 1.0)


_DOMAIN = "CASE WHEN domain IS NULL OR domain = '' THEN 0.0 ELSE pmod(xxhash64(lower(trim(domain))), 1000) / 1000.0 END"


def _format(kind: str, weight: float, default: float = 0.0) -> str:
    return coded("input_format", positions(FORMATS[kind], weight), default)


def _log6(c: str) -> str:
    return f"least(log10(greatest({c}, 1)) / 6.0, 1.0)"


ENCODINGS: dict[str, list[str]] = {
    "tabular": [
        _task("tabular"), _DOMAIN, coded("budget", BUDGETS, 0.67), coded("quality", QUALITIES, 0.75), flag("supervision = 'supervised'"),
        coded("task_type", TASK_POSITION, 0.5), _format("tabular", FORMAT_WEIGHT),
        _log6("n_rows"), "least(n_cols / 100.0, 1.0)", "missing_ratio", "least(imbalance_ratio, 20.0) / 20.0", "num_col_ratio", "cat_col_ratio",
        *[flag(f) for f in ("has_outliers", "has_high_skew", "is_imbalanced", "is_highly_imbalanced")],
        coded("num_imputer", positions(("mean", "median", "knn")), 0.0), coded("scaler", positions(("none", "standard", "minmax", "robust")), 1 / 3),
        coded("encoder", positions(("onehot", "ordinal")), 0.0), coded("imbalance", positions(("none", "oversample", "smote")), 0.0),
        *[flag(f) for f in ("power_transform", "outlier_clip", "remove_duplicates", "remove_low_variance", "drop_high_missing_cols")],
    ],
    "text": [
        _task("text"), _format("text", 1.0, 1.0), _log6("n_samples"), "least(n_classes, 200.0) / 200.0", "least(avg_token_length, 1000.0) / 1000.0",
        "least(token_length_std, 1000.0) / 1000.0", _log6("vocabulary_size"), "duplicate_ratio", "empty_text_ratio", "noise_ratio",
        "least(imbalance_ratio, 50.0) / 50.0", "annotation_invalid_ratio", "least(source_target_length_ratio, 5.0) / 5.0", flag("has_tabular_features"),
        "least(num_extra_numeric_cols, 50.0) / 50.0", "least(num_extra_categorical_cols, 50.0) / 50.0", "extra_feature_missing_ratio",
        *[flag(f) for f in ("has_text", "has_labels", "has_multilabels", "has_entity_annotations", "has_pos_tags", "has_relation_labels",
                            "has_similarity_pairs", "has_summaries", "has_qa_fields", "has_generation_references", "has_auxiliary_features", "is_plain_corpus")],
        flag("lowercase"), flag("clean_urls_emails_html"), flag("emoji_handling <> 'keep'"),
        coded("punctuation_handling", positions(("keep", "space", "remove")), 0.0), coded("number_normalization", positions(("keep", "replace", "remove")), 0.0),
        flag("stopword_removal"), flag("normalization_strategy <> 'none'"), "least(max_sequence_length, 1000.0) / 1000.0", "least(min_df, 10.0) / 10.0",
        coded("representation", positions(("raw_text", "tfidf_word", "tfidf_char", "tfidf_char_word", "token_sequence")), 0.25),
        flag("imbalance <> 'none'"), flag("fusion_strategy = 'concatenate_text_tabular'"),
    ],
    "image": [
        _task("image"), _DOMAIN, _format("image", FORMAT_WEIGHT),
        *[f"{FLAG_WEIGHT} * {flag(f)}" for f in ("has_class_labels", "has_bboxes", "has_masks", "has_keypoints", "has_text_labels", "has_depth_targets")],
        _log6("n_images"), "least(greatest(n_classes, 1) / 100.0, 1.0)", "least(imbalance_ratio, 20.0) / 20.0", "avg_brightness", "brightness_std",
        "avg_contrast", "contrast_std", "grayscale_ratio", *[flag(f) for f in ("has_varied_sizes", "has_low_contrast", "is_imbalanced", "is_highly_imbalanced")],
        "least(resize / 256.0, 1.0)", coded("color_mode", positions(("rgb", "grayscale")), 0.0), coded("normalization", positions(("none", "standard", "minmax")), 0.5),
        *[flag(f) for f in ("histogram_eq", "denoise", "sharpen", "augment_h_flip", "augment_v_flip")],
        coded("augment_rotation", positions(("none", "light", "moderate")), 0.0), flag("augment_color_jitter"), coded("imbalance", positions(("none", "oversample")), 0.0),
    ],
    "audio": [
        _task("audio"), _log6("n_audio_files"), "least(n_classes, 100.0) / 100.0", "least(avg_duration_sec, 120.0) / 120.0", "least(duration_std_sec, 120.0) / 120.0",
        "least(imbalance_ratio, 20.0) / 20.0", "silence_ratio", "clipping_ratio", "corruption_ratio", "estimated_noise_ratio", "least(n_rates, 10) / 10.0",
        "least(n_channel_counts, 10) / 10.0", coded("input_format", {f: i / 3 for i, f in enumerate(FORMATS["audio"])}, 0.0),
        *[flag(f) for f in ("has_class_labels", "has_transcripts", "has_speaker_labels", "has_speaker_pairs", "has_temporal_segments", "has_anomaly_labels", "has_noisy_clean_pairs")],
        "least(target_sample_rate / 48000.0, 1.0)", flag("mono"), flag("trim_silence"), coded("loudness_normalization", positions(("none", "rms", "peak")), 0.5),
        coded("noise_filter", positions(("none", "highpass", "spectral_gate")), 0.0), flag("clipping_handling <> 'none'"),
        coded("feature_representation", positions(("mfcc", "mel_spectrogram", "log_mel_spectrogram", "raw_waveform")), 0.0),
        flag("augmentation <> 'none'"), flag("imbalance <> 'none'"),
    ],
}


def encoded(df: DataFrame, kind: str, out: str = "x") -> DataFrame:
    """Feature array of every evaluated or candidate row: 26, 41, 32 or 29 values by modality."""
    return df.withColumn(out, F.array(*[F.expr(e).cast("double") for e in ENCODINGS[kind]]))


def fit(evaluations: DataFrame, kind: str, score: str = "score") -> tuple[PipelineModel, int] | None:
    """(model, rows) of a forest over encoded past evaluations; None below three rows."""
    rows = encoded(evaluations, kind).select("x", F.col(score).cast("double").alias("label")).filter("label IS NOT NULL")
    rows = cut_lineage(rows)  # the forest's passes read the encoded rows, not the runs behind them
    n = rows.count()
    if n < 3:
        return None
    size = len(ENCODINGS[kind])
    wide = rows.select("label", *[F.col("x")[i].alias(f"x{i}") for i in range(size)])
    assembler = VectorAssembler(inputCols=[f"x{i}" for i in range(size)], outputCol="features")
    forest = RandomForestRegressor(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=MIN_LEAF, seed=42)
    return PipelineModel([assembler, forest.fit(assembler.transform(wide))]), n


def predict(model: PipelineModel, df: DataFrame, kind: str, out: str = "predicted") -> DataFrame:
    size = len(ENCODINGS[kind])
    wide = encoded(df, kind).select(*df.columns, *[F.col("x")[i].alias(f"x{i}") for i in range(size)])
    scored = model.transform(wide).drop("features", *[f"x{i}" for i in range(size)])
    return scored.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))).drop("prediction")


def weight(n_rows: int) -> float:
    """0 below five past rows, growing to 0.25 at twenty."""
    if n_rows < MIN_ROWS:
        return 0.0
    return MAX_WEIGHT * min((n_rows - MIN_ROWS) / (FULL_ROWS - MIN_ROWS), 1.0)


def rerank(candidates: DataFrame, n_rows: int, key: str = "dataset", predicted: str = "predicted") -> DataFrame:
    """New ``rank`` by (1 - w) * position score + w * prediction; a missing prediction falls back to the position."""
    w = weight(n_rows)
    size = F.count("*").over(Window.partitionBy(key))
    place = (size - F.col("rank") + 1) / size
    combined = candidates.withColumn("combined", (1 - w) * place + w * F.coalesce(F.col(predicted), place))
    order = Window.partitionBy(key).orderBy(F.desc("combined"), "rank")
    return combined.withColumn("new_rank", F.row_number().over(order).cast("long"))
