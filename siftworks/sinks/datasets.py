"""Writers for cleaned tables, texts and corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TextSpec, clean_text, safe_stem
from ..operators.ordering import with_position
from ..session import cut_lineage


def processed_columns(df: DataFrame, text_cols: Sequence[str], spec: TextSpec = TextSpec()) -> DataFrame:
    """Original columns plus a cleaned copy of each text column."""
    return df.withColumns({f"{c}_processed": clean_text(F.col(c), spec) for c in text_cols})


def write_processed_text(df: DataFrame, text_cols: Sequence[str], path: str, fmt: str = "json", spec: TextSpec = TextSpec()) -> None:
    """CSV or JSON lines; every task writes its own part."""
    writer = processed_columns(df, text_cols, spec).write.mode("overwrite")
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).format(fmt).save(path)


def write_cleaned_table(model: Model, df: DataFrame, target: str | None, path: str, fmt: str = "parquet") -> DataFrame:
    """Apply a fitted cleaning pipeline to all rows and write features with the target last. No resampling."""
    out = model.transform(df)
    if target:
        out = out.select(*[c for c in out.columns if c != target], target)
    writer = out.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
    return out


def unique_names(df: DataFrame, name: str, key: str, folder: str | None = None, out: str = "file_name") -> DataFrame:
    """Safe file names; the second, third, ... row with a name gets the suffix _1, _2, ... in key order."""
    named = df.withColumn(out, safe_stem(F.col(name)))
    group = ([folder] if folder else []) + [out]
    pos = with_position(named, [F.col(key)], group, "_n")
    suffix = F.when(F.col("_n") > 1, F.concat(F.lit("_"), (F.col("_n") - 1).cast("string"))).otherwise(F.lit(""))
    return pos.withColumn(out, F.concat(out, suffix)).drop("_n")


def write_corpus(df: DataFrame, key: str, name: str, text: str, label: str, path: str, spec: TextSpec = TextSpec()) -> DataFrame:
    """Cleaned documents partitioned by label, one line-safe record per document, and a manifest beside them."""
    # names first, so that texts are cleaned once and not for the samples that cut the ranges
    docs = unique_names(df.select(*dict.fromkeys([key, name, text, label])), name, key, label)
    kept = docs.select(F.col(label).alias("label"), F.col("file_name"), clean_text(F.col(text), spec).alias("text"))
    rows = cut_lineage(kept.withColumn("n_chars", F.length("text")))
    rows.select("label", "file_name", "text").write.mode("overwrite").partitionBy("label").json(f"{path}/documents")
    manifest = rows.select("file_name", "label", "n_chars")
    manifest.write.mode("overwrite").option("header", True).csv(f"{path}/metadata")
    return manifest
