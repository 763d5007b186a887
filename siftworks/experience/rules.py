"""Candidate rules as data: SQL expressions over a profile row, one rule set per modality.

A rule set has the spec fields, a plain first spec, derived columns, a tuned spec, and moves. A move is a condition with
the fields in which its spec differs from the tuned one. Every dataset's specs come out of one projection, so thousands
of profiles are handled together."""

from __future__ import annotations

from dataclasses import dataclass, field


def either(cond: str, yes: str, no: str) -> str:
    return f"CASE WHEN {cond} THEN {yes} ELSE {no} END"


@dataclass(frozen=True)
class RuleSet:
    plain: dict[str, str]
    derived: dict[str, str]
    tuned: dict[str, str]
    moves: list[tuple[str, dict[str, str]]]
    pattern: tuple[str, ...]
    cap: str
    constraints: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def fields(self) -> list[str]:
        return list(self.plain)

    def specs(self) -> list[tuple[str, dict[str, str]]]:
        return [("true", self.plain)] + [(cond, {**self.tuned, **change}) for cond, change in self.moves]


# Specs, conditions, caps and constraint effects of the tabular rules.
TABULAR = RuleSet(
    plain={
        "num_imputer": "'mean'", "cat_imputer": "'mode'", "scaler": "'standard'", "power_transform": "false",
        "encoder": "'onehot'", "remove_duplicates": "false", "remove_low_variance": "false", "imbalance": "'none'",
        "outlier_clip": "false", "drop_high_missing_cols": "false",
    },
    derived={
        "guarded": "(has_outliers AND quality <> 'clean') OR quality = 'noisy'",
        "powered": "has_high_skew AND quality <> 'clean' AND budget <> 'minimal'",
        "smote_ok": "is_highly_imbalanced AND min_class_size >= 6 AND budget <> 'minimal'",
        "labelled": "task_type NOT IN ('clustering', 'anomaly', 'association_rules', 'regression', 'time_series')",
        "central": either("has_outliers OR has_high_missing OR quality = 'noisy'", "'median'", "'mean'"),
        "resample": "CASE WHEN NOT labelled OR NOT is_imbalanced THEN 'none' WHEN smote_ok THEN 'smote' ELSE 'oversample' END",
        "repeat_rows": either("labelled AND is_imbalanced", "'oversample'", "'none'"),
    },
    tuned={
        "num_imputer": "central", "cat_imputer": "'mode'", "scaler": either("guarded", "'robust'", "'standard'"),
        "power_transform": "powered", "encoder": "'onehot'", "remove_duplicates": "has_duplicates",
        "remove_low_variance": "has_constant_cols", "imbalance": "'none'", "outlier_clip": "guarded",
        "drop_high_missing_cols": "has_high_missing_cols",
    },
    moves=[
        ("true", {}),
        ("is_imbalanced AND labelled", {"imbalance": "resample"}),
        ("budget <> 'minimal' AND is_imbalanced AND labelled", {"imbalance": "repeat_rows"}),
        ("budget <> 'minimal' AND has_categorical", {"power_transform": "false", "encoder": "'ordinal'", "imbalance": "resample"}),
        ("budget <> 'minimal'", {
            "num_imputer": either("central = 'median'", "'mean'", "'median'"), "scaler": either("guarded", "'standard'", "'minmax'"),
            "power_transform": "false", "outlier_clip": "false"}),
        ("budget <> 'minimal' AND has_high_cardinality", {
            "cat_imputer": "'constant'", "scaler": "'minmax'", "power_transform": "false", "encoder": "'ordinal'",
            "imbalance": "repeat_rows", "outlier_clip": "false"}),
        ("budget IN ('moderate', 'heavy') AND has_missing AND n_rows <= 5000", {
            "num_imputer": "'knn'", "cat_imputer": "'constant'", "power_transform": "false", "imbalance": "resample", "outlier_clip": "false"}),
        ("budget NOT IN ('minimal', 'light') AND has_high_skew AND NOT powered", {
            "scaler": "'standard'", "power_transform": "true", "imbalance": "resample"}),
        ("budget NOT IN ('minimal', 'light')", {"cat_imputer": "'constant'", "imbalance": "resample"}),
        ("budget NOT IN ('minimal', 'light') AND has_outliers", {
            "num_imputer": "'median'", "scaler": "'robust'", "power_transform": "false", "imbalance": "resample", "outlier_clip": "true"}),
    ],
    pattern=("num_imputer", "scaler", "encoder", "imbalance"),
    cap="least(CASE budget WHEN 'minimal' THEN 4 WHEN 'light' THEN 8 ELSE 12 END, CASE WHEN array_contains(constraints, 'prefer_simple') THEN 4 ELSE 12 END)",
    constraints=[
        ("no_smote", "imbalance", either("imbalance = 'smote'", "'oversample'", "imbalance")),
        ("no_scaling", "scaler", "'none'"),
        ("no_power_transform", "power_transform", "false"),
        ("no_outlier_clip", "outlier_clip", "false"),
        ("no_variance_filter", "remove_low_variance", "false"),
    ],
)

# Specs, conditions, caps and constraint effects of the text rules.
_CLASSES = "(task_type IN ('classification_single', 'classification_multi'))"
_PAIRS = "(task_type IN ('summarization', 'question_answering', 'semantic_similarity'))"
_TEXT_PLAIN = {
    "lowercase": "task_type <> 'ner'", "clean_urls_emails_html": "noisy", "emoji_handling": "usual_emoji", "punctuation_handling": "'keep'",
    "number_normalization": "'keep'", "whitespace_normalization": "true", "stopword_removal": "false", "normalization_strategy": "'none'",
    "tokenization_strategy": "'word'", "max_sequence_length": either("avg_token_length > 300", "512", "256"), "min_df": "1",
    "representation": "'tfidf_word'", "imbalance": "balance", "fusion_strategy": "'text_only'", "numeric_imputation": "'mean'",
    "numeric_scaling": "'standard'", "categorical_encoding": "'onehot'",
}
_TEXT_STRICT = {
    "emoji_handling": either("task_type = 'topic_modeling'", "'remove'", "usual_emoji"),
    "punctuation_handling": either(_CLASSES, "'remove'", "'keep'"), "number_normalization": either(_CLASSES, "'replace'", "'keep'"),
    "stopword_removal": _CLASSES, "max_sequence_length": "256",
}
_AS_IS = {
    "lowercase": "false", "clean_urls_emails_html": "false", "emoji_handling": "'keep'", "representation": "'raw_text'", "imbalance": "'none'"}
_ALL_OUT = {
    "lowercase": "true", "clean_urls_emails_html": "true", "emoji_handling": "'remove'", "punctuation_handling": "'remove'",
    "number_normalization": "'replace'", "stopword_removal": "true", "max_sequence_length": "256", "min_df": "2"}
_FUSED = {"fusion_strategy": "'concatenate_text_tabular'"}
TEXT = RuleSet(
    plain=_TEXT_PLAIN,
    derived={
        "noisy": "noise_ratio > 0.1",
        "balance": either(f"{_CLASSES} AND imbalance_ratio > 1.5", "'class_weight'", "'none'"),
        "usual_emoji": f"CASE WHEN task_type = 'ner' OR {_PAIRS} THEN 'preserve' WHEN task_type = 'topic_modeling' THEN 'remove' ELSE 'limit_then_translate' END",
        "fusable": "has_tabular_features AND fusion_task AND task_type <> 'ner'",
    },
    tuned=_TEXT_PLAIN,
    moves=[
        ("true", _TEXT_STRICT),
        ("true", {"lowercase": "false", "emoji_handling": either("task_type = 'ner'", "'preserve'", "'keep'"), "max_sequence_length": "512", "representation": "'tfidf_char'"}),
        ("true", {"clean_urls_emails_html": "true", "emoji_handling": either("task_type = 'ner'", "'preserve'", "'translate_to_text'"),
                  "punctuation_handling": "'space'", "number_normalization": "'replace'", "max_sequence_length": "512", "min_df": "2"}),
        ("true", {**_AS_IS, "max_sequence_length": either(_PAIRS, "100000", "512")}),
        (f"{_CLASSES} OR task_type = 'topic_modeling'", {**_ALL_OUT, "normalization_strategy": "'stem'"}),
        (f"{_CLASSES} OR task_type = 'topic_modeling'", {
            **_ALL_OUT, "punctuation_handling": "'keep'", "stopword_removal": "false", "tokenization_strategy": "'char_word'", "representation": "'tfidf_char_word'"}),
        ("task_type = 'topic_modeling'", {**_ALL_OUT, "max_sequence_length": "512", "imbalance": "'none'"}),
        ("task_type = 'ner'", {
            **_AS_IS, "whitespace_normalization": "false", "tokenization_strategy": "'pretokenized'", "max_sequence_length": "100000", "representation": "'token_sequence'"}),
        (_PAIRS, {**_AS_IS, "clean_urls_emails_html": "noisy", "max_sequence_length": "100000"}),
        ("fusable", _FUSED),
        ("fusable", {**_TEXT_STRICT, **_FUSED}),
        ("fusable", {**_FUSED, "numeric_imputation": "'median'", "numeric_scaling": "'robust'", "categorical_encoding": "'ordinal'"}),
    ],
    pattern=("representation", "lowercase", "stopword_removal", "punctuation_handling", "fusion_strategy"),
    cap="14",
    constraints=[
        ("no_stemming", "normalization_strategy", either("normalization_strategy = 'stem'", "'none'", "normalization_strategy")),
        ("no_lemmatization", "normalization_strategy", either("normalization_strategy = 'lemma'", "'none'", "normalization_strategy")),
        ("no_stopword_removal", "stopword_removal", "false"),
        ("preserve_case", "lowercase", "false"),
        ("no_truncation", "max_sequence_length", "100000"),
        ("keep_punctuation", "punctuation_handling", "'keep'"),
        ("keep_whitespace", "whitespace_normalization", "false"),
    ],
)

# Specs, conditions, caps and constraint effects of the image rules.
_IMAGE_PLAIN = {
    "resize": "64", "color_mode": "'rgb'", "normalization": "'standard'", "histogram_eq": "false", "denoise": "false", "sharpen": "false",
    "augment_h_flip": "false", "augment_v_flip": "false", "augment_rotation": "'none'", "augment_color_jitter": "false", "imbalance": "'none'",
}
_IMAGE_TUNED = {
    **_IMAGE_PLAIN, "resize": "main_size", "color_mode": either("has_mostly_grayscale", "'grayscale'", "'rgb'"),
    "normalization": either("has_varied_brightness", "'minmax'", "'standard'"), "histogram_eq": "equalise", "denoise": "has_varied_brightness",
    "sharpen": "has_low_contrast",
}
_UNFILTERED = {"histogram_eq": "false", "denoise": "false", "sharpen": "false"}
IMAGE = RuleSet(
    plain=_IMAGE_PLAIN,
    derived={
        "equalise": "has_low_contrast OR has_high_contrast_variance",
        "classed": "task_type IN ('classification', 'multilabel', 'anomaly')",
        "repeat_rows": either("classed AND is_imbalanced", "'oversample'", "'none'"),
        "main_size": "CASE WHEN has_small_images AND min_height >= 32 AND min_width >= 32 THEN 32 WHEN has_large_images AND NOT has_small_images THEN 128 ELSE 64 END",
    },
    tuned=_IMAGE_TUNED,
    moves=[
        ("true", {}),
        ("classed AND is_imbalanced", {"imbalance": "'oversample'"}),
        ("true", {"denoise": "false", "sharpen": "false", "augment_h_flip": "true", "augment_rotation": "'light'",
                  "imbalance": either("classed AND is_highly_imbalanced", "'oversample'", "'none'")}),
        ("true", {**_UNFILTERED, "resize": either("main_size >= 64", "32", "64"), "normalization": "'minmax'"}),
        ("true", {"color_mode": either("has_mostly_grayscale", "'rgb'", "'grayscale'"), "sharpen": "false"}),
        ("has_low_contrast", {"normalization": "'minmax'", "histogram_eq": "true", "denoise": "false", "sharpen": "true", "imbalance": "repeat_rows"}),
        ("true", {"augment_h_flip": "true", "augment_rotation": "'moderate'", "augment_color_jitter": "true", "imbalance": "repeat_rows"}),
        ("main_size <> 128", {**_UNFILTERED, "resize": "128"}),
        ("has_varied_sizes", {"normalization": "'minmax'", "histogram_eq": "true", "denoise": "true", "sharpen": "false"}),
        ("true", {**_UNFILTERED, "color_mode": "'grayscale'", "normalization": "'standard'", "histogram_eq": "true", "augment_h_flip": "true",
                  "augment_rotation": "'light'", "imbalance": "repeat_rows"}),
    ],
    pattern=("resize", "color_mode", "normalization", "imbalance"),
    cap="12",
    constraints=[
        ("no_augmentation", "augment_h_flip", "false"), ("no_augmentation", "augment_v_flip", "false"),
        ("no_augmentation", "augment_rotation", "'none'"), ("no_augmentation", "augment_color_jitter", "false"),
        ("no_normalization", "normalization", "'none'"), ("no_resize", "resize", "0"),
        ("grayscale_only", "color_mode", "'grayscale'"), ("no_color_jitter", "augment_color_jitter", "false"),
    ],
)

# Specs, conditions, caps and constraint effects of the audio rules.
_AUDIO_PLAIN = {
    "target_sample_rate": "16000", "mono": "true", "trim_silence": "false", "duration_strategy": "'preserve'", "loudness_normalization": "'rms'",
    "noise_filter": "'none'", "clipping_handling": "'none'", "feature_representation": "'mfcc'", "augmentation": "'none'", "imbalance": "'none'",
}
_AUDIO_TUNED = {**_AUDIO_PLAIN, "imbalance": "balance"}
_FITTED = {"trim_silence": "trims", "duration_strategy": "'pad_or_trim'", "clipping_handling": either("clipping_ratio > 0.01", "'soft_limit'", "'none'")}
AUDIO = RuleSet(
    plain=_AUDIO_PLAIN,
    derived={
        "balance": either("task_type IN ('classification', 'speaker_recognition', 'sound_event_detection', 'anomaly') AND imbalance_ratio > 1.5", "'oversample'", "'none'"),
        "trims": "silence_ratio > 0.05 AND task_type NOT IN ('asr', 'sound_event_detection', 'noise_suppression')",
        "hisses": "estimated_noise_ratio > 0.25 AND task_type <> 'speaker_recognition'",
        "rate": "CASE WHEN n_rates = 1 AND native_rate <= 48000 THEN native_rate WHEN task_type IN ('asr', 'speaker_recognition', 'vad', 'noise_suppression') THEN 16000 ELSE 22050 END",
    },
    tuned=_AUDIO_TUNED,
    moves=[
        ("true", {**_FITTED, "target_sample_rate": "rate", "noise_filter": either("hisses", "'highpass'", "'none'")}),
        ("true", {"target_sample_rate": "rate", "loudness_normalization": "'peak'", "feature_representation": "'log_mel_spectrogram'"}),
        ("true", {**_FITTED, "target_sample_rate": "22050", "noise_filter": either("hisses", "'spectral_gate'", "'none'"),
                  "feature_representation": "'mel_spectrogram'", "augmentation": "'time_shift'"}),
        ("true", {"target_sample_rate": "0", "mono": "false", "loudness_normalization": "'none'", "feature_representation": "'raw_waveform'", "imbalance": "'none'"}),
        ("true", {"noise_filter": either("hisses", "'highpass'", "'none'"), "augmentation": "'background_noise'"}),
        ("task_type = 'asr'", {"feature_representation": "'log_mel_spectrogram'", "imbalance": "'none'"}),
        ("task_type = 'speaker_recognition'", {"loudness_normalization": "'none'"}),
        ("task_type = 'sound_event_detection'", {"target_sample_rate": "22050", "feature_representation": "'log_mel_spectrogram'", "augmentation": "'time_shift'"}),
        ("task_type = 'noise_suppression'", {"noise_filter": "'spectral_gate'", "clipping_handling": "'soft_limit'", "feature_representation": "'log_mel_spectrogram'", "imbalance": "'none'"}),
    ],
    pattern=("target_sample_rate", "feature_representation", "noise_filter", "loudness_normalization"),
    cap="12",
    constraints=[
        ("no_resampling", "target_sample_rate", "0"), ("preserve_sample_rate", "target_sample_rate", "0"),
        ("no_normalization", "loudness_normalization", "'none'"), ("no_augmentation", "augmentation", "'none'"),
        ("preserve_duration", "duration_strategy", "'preserve'"), ("preserve_duration", "trim_silence", "false"), ("mono_only", "mono", "true"),
        ("no_noise_reduction", "noise_filter", "'none'"), ("no_silence_removal", "trim_silence", "false"),
    ],
)

RULE_SETS = {"tabular": TABULAR, "text": TEXT, "image": IMAGE, "audio": AUDIO}

# What each tabular step adds to the complexity used for tie-breaks.
TABULAR_COMPLEXITY = (
    "CASE WHEN num_imputer = 'knn' THEN 2 ELSE 0 END + CASE WHEN power_transform THEN 1 ELSE 0 END + CASE WHEN outlier_clip THEN 1 ELSE 0 END"
    " + CASE WHEN scaler <> 'none' THEN 1 ELSE 0 END + CASE imbalance WHEN 'smote' THEN 2 WHEN 'oversample' THEN 1 ELSE 0 END"
    " + CASE WHEN remove_low_variance THEN 1 ELSE 0 END + CASE WHEN drop_high_missing_cols THEN 1 ELSE 0 END"
)
