"""Corpus profile: lengths, vocabulary, noise, scripts, labels and annotation checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import COUNTED_EMOJI, EMOJI_RUN, WORD, parse_list, token_count, word_tokens, words

# Noise patterns, length buckets, script ranges.
NOISE = {
    "urls": r"https?://|www\.",
    "emails": rf"{WORD}[\p{{L}}\p{{N}}_.\-]*@[\p{{L}}\p{{N}}_.\-]+\.{WORD}",
    "html": r"<[^>]+>",
    "emojis": r"[\x{10000}-\x{10FFFF}]",
    "excessive_punctuation": r"([!?.,])\1{2,}",
    "numbers": r"\p{Nd}",
    "all_caps": r"(?<![\p{L}\p{N}_])[A-Z]{4,}(?![\p{L}\p{N}_])",
    "mentions": rf"@{WORD}",
    "hashtags": rf"#{WORD}",
}
LENGTH_BUCKETS = ((10, "<10 words"), (100, "10-99 words"), (500, "100-499 words"))
ARABIC, CHINESE = r"[\x{0600}-\x{06FF}]", r"[\x{4E00}-\x{9FFF}]"
LATIN_SHARE = 0.7


def _text(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def length_bucket(n: Column) -> Column:
    out = F.when(n == 0, "empty")
    for limit, name in LENGTH_BUCKETS:
        out = out.when(n < limit, name)
    return out.otherwise("500+ words")


def length_stats(df: DataFrame, text: str) -> DataFrame:
    sized = df.select(F.length(_text(text)).alias("chars"), token_count(_text(text)).alias("tokens"))
    return sized.agg(*[
        g(c).alias(f"{name}_{c}") for c in ("chars", "tokens")
        for name, g in (("avg", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))
    ])


def length_distribution(df: DataFrame, text: str) -> DataFrame:
    return df.groupBy(length_bucket(token_count(_text(text))).alias("bucket")).agg(F.count("*").alias("n"))


def vocabulary_stats(df: DataFrame, text: str) -> DataFrame:
    """Vocabulary size and share of distinct tokens; token counts are combined before the shuffle."""
    counts = df.select(F.explode(word_tokens(_text(text))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    out = counts.agg(F.count("*").alias("vocabulary_size"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    return out.withColumn("unique_token_ratio", F.col("vocabulary_size") / F.greatest("n_tokens", F.lit(1)))


def empty_and_duplicate_texts(df: DataFrame, text: str) -> DataFrame:
    counts = df.groupBy(_text(text).alias("t")).agg(F.count("*").alias("n"))
    return counts.agg(
        F.coalesce(F.sum(F.when(F.trim("t") == "", F.col("n"))), F.lit(0)).alias("n_empty"),
        F.sum(F.col("n") - 1).alias("n_duplicates"),
    )


def noise_profile(df: DataFrame, text: str) -> DataFrame:
    """(detector, n, ratio) for the nine detectors and ``any``: one scan, one aggregation."""
    hits = df.select(*[F.rlike(_text(text), F.lit(p)).alias(k) for k, p in NOISE.items()])
    one = hits.agg(
        F.count("*").alias("rows"), *[F.count_if(k).alias(k) for k in NOISE],
        F.count_if(F.greatest(*[F.col(k) for k in NOISE])).alias("any"))
    cells = [F.struct(F.lit(k).alias("detector"), F.col(k).alias("n"), F.col("rows")) for k in (*NOISE, "any")]
    return one.select(F.inline(F.array(*cells))).withColumn("ratio", F.col("n") / F.greatest("rows", F.lit(1))).drop("rows")


def script(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    return (
        F.when(F.rlike(text, F.lit(ARABIC)), "Arabic")
        .when(F.rlike(text, F.lit(CHINESE)), "Chinese")
        .when((letters > 0) & (latin / letters > LATIN_SHARE), "Latin")
        .otherwise("Unknown")
    )


def script_distribution(df: DataFrame, text: str) -> DataFrame:
    return df.groupBy(script(_text(text)).alias("script")).agg(F.count("*").alias("n"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def list_label_counts(df: DataFrame, labels: str) -> DataFrame:
    """Counts of the labels in list cells."""
    return df.select(F.explode(parse_list(F.col(labels))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def binary_label_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    truth = {c: F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)) != 0 for c in cols}
    one = df.agg(*[F.count_if(t).alias(c) for c, t in truth.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in cols])))


def label_summary(counts: DataFrame) -> DataFrame:
    """Classes, smallest class and imbalance of (label, n); NULL imbalance when a label never occurs."""
    return counts.agg(
        F.count("*").alias("n_classes"), F.min("n").alias("min_class"),
        F.when(F.min("n") > 0, F.max("n") / F.min("n")).alias("imbalance"))


def missing_targets(df: DataFrame, label: str) -> DataFrame:
    return df.agg(F.count_if(F.trim(_text(label)) == "").alias("n_missing"))


def length_ratio(df: DataFrame, source: str, target: str) -> DataFrame:
    ratio = token_count(_text(target)) / F.greatest(token_count(_text(source)), F.lit(1))
    return df.agg(F.avg(ratio).alias("source_target_length_ratio"))


def emoji_stats(df: DataFrame, text: str, strategy: str) -> DataFrame:
    total = F.coalesce(F.sum(F.regexp_count(_text(text), F.lit(COUNTED_EMOJI))), F.lit(0))
    runs = F.count_if(F.rlike(_text(text), F.lit(EMOJI_RUN)))
    translated = strategy in ("translate_to_text", "describe", "limit_then_translate")
    return df.agg(
        (total if translated else F.lit(0)).cast("long").alias("emoji_translated_count"),
        (total if strategy == "remove" else F.lit(0)).cast("long").alias("emoji_removed_count"),
        (runs if strategy == "limit_then_translate" else F.lit(0)).cast("long").alias("removed_excessive_emoji_count"),
    ) if (translated or strategy == "remove") else df.agg(F.count("*").alias("n")).select(*[
        F.lit(0).cast("long").alias(c) for c in ("emoji_translated_count", "emoji_removed_count", "removed_excessive_emoji_count")])


ENTITY = "array<struct<start:int,end:int,label:string>>"


def valid_entities(cell: Column) -> tuple[Column, Column]:
    """(valid, entity count) of an entity cell: spans as JSON objects or triples, else BIO tags."""
    as_list = F.rlike(cell, F.lit(r"^\s*\["))
    spans = F.from_json(cell, "array<map<string,string>>")
    keyed = F.filter(spans, lambda m: F.map_contains_key(m, "start") & F.map_contains_key(m, "end") & F.map_contains_key(m, "label"))
    triples = F.from_json(cell, "array<array<string>>")
    long_enough = F.filter(triples, lambda t: F.size(t) >= 3)
    objects = F.rlike(cell, F.lit(r"^\s*\[\s*\{"))
    ok = F.when(objects, F.size(keyed)).otherwise(F.size(long_enough))
    total = F.when(objects, F.size(spans)).otherwise(F.size(triples))
    tags = words(cell)
    bio = (F.size(tags) > 0) & F.forall(tags, lambda t: (t == "O") | t.startswith("B-") | t.startswith("I-"))
    starts = F.size(F.filter(tags, lambda t: t.startswith("B-")))
    valid = F.when(as_list, (ok == total) & (total >= 0)).otherwise(bio)
    count = F.when(as_list, F.greatest(ok, F.lit(0))).when(bio, starts).otherwise(F.lit(0))
    return F.coalesce(valid, F.lit(False)), F.coalesce(count, F.lit(0))


def valid_answer(context: Column, answer: Column) -> Column:
    return (F.trim(answer) != "") & F.contains(F.lower(context), F.lower(answer))


def valid_tags(tokens: Column, tags: Column) -> Column:
    return (F.size(tags) > 0) & (F.size(tokens) == F.size(tags))


def validity(df: DataFrame, ok: Column) -> DataFrame:
    flag = F.coalesce(ok, F.lit(False))
    return df.agg(
        F.count_if(flag).alias("valid_count"), F.count_if(~flag).alias("invalid_count"),
        F.avg(flag.cast("int")).alias("valid_ratio"))


def corpus_buckets(summary: DataFrame) -> DataFrame:
    """Size, length, variance and vocabulary buckets of profile rows (n_samples, avg_tokens, std_tokens, vocabulary_size)."""
    spread = F.col("std_tokens") / F.greatest(F.col("avg_tokens"), F.lit(1e-6))

    def three(c, low, high, names):
        return F.when(c < low, names[0]).when(c < high, names[1]).otherwise(names[2])

    return summary.withColumns({
        "sample_count_bucket": three(F.col("n_samples"), 500, 5000, ("small", "medium", "large")),
        "sample_count_ratio": F.least(F.log10(F.greatest(F.col("n_samples"), F.lit(1))) / 6, F.lit(1.0)),
        "average_length_bucket": three(F.col("avg_tokens"), 30, 300, ("short", "medium", "long")),
        "length_variance_bucket": three(spread, 0.25, 1.0, ("low", "medium", "high")),
        "vocabulary_size_bucket": three(F.col("vocabulary_size"), 2000, 50000, ("small", "medium", "large")),
    })


def auxiliary_ratios(missing: DataFrame, n_text_columns: int) -> DataFrame:
    """Mean missing share over auxiliary columns and text columns per auxiliary column."""
    return missing.agg(
        F.coalesce(F.avg("missing_ratio"), F.lit(0.0)).alias("extra_feature_missing_ratio"),
        (F.lit(float(n_text_columns)) / F.greatest(F.count("*"), F.lit(1))).alias("text_to_tabular_feature_ratio"))
