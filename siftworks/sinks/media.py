"""Writers for processed images and signals: Parquet arrays per label with a manifest, read back without decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import images, signals


def write_signals(df: DataFrame, path: str, trim: bool = False, limit: bool = False, norm: str = "rms") -> None:
    """Cleaned signals (path, label, rate, samples) as 16-bit values per label, and their metadata."""
    y = signals.standardize(F.col("samples"), F.col("rate"), trim, limit, norm)
    pcm = F.transform(y, lambda v: F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), v)) * 32767).cast("smallint"))
    out = df.select("path", "label", F.col("rate").alias("sample_rate"), pcm.alias("pcm"))
    out.write.mode("overwrite").partitionBy("label").parquet(f"{path}/signals")
    meta = out.select("path", "label", "sample_rate", F.size("pcm").alias("n_samples"), (F.size("pcm") / F.col("sample_rate")).alias("duration"))
    meta.write.mode("overwrite").option("header", True).csv(f"{path}/metadata")


def write_images(df: DataFrame, spec: images.ImageSpec, path: str, boxes: DataFrame | None = None) -> None:
    """Standardised pixels (path, label, pixels) as bytes scaled to 0..255 per image, metadata, and box annotations."""
    px = images.standardized(df, spec).select("path", "label", "pixels")
    lo, hi = F.array_min("pixels"), F.array_max("pixels")
    if spec.normalization == "none":
        byte = F.transform("pixels", lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), v)).cast("smallint"))
    else:
        byte = F.transform("pixels", lambda v: F.when(hi > lo, (v - lo) / (hi - lo) * 255).otherwise(F.lit(0.0)).cast("smallint"))
    out = px.select("path", "label", byte.alias("pixels"))
    out.write.mode("overwrite").partitionBy("label").parquet(f"{path}/images")
    out.select("path", "label", F.size("pixels").alias("n_values")).write.mode("overwrite").option("header", True).csv(f"{path}/metadata")
    if boxes is not None:
        boxes.write.mode("overwrite").parquet(f"{path}/annotations")
