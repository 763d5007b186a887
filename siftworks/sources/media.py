"""Image and WAV files as rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpora import extension, is_hidden, relative_path

IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp")
AUDIO_EXTENSIONS = ("wav",)


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(path, label, size_kb, image, corrupt): pixels by the image source, label from the first folder. A file that does
    not decode stays as a row marked corrupt."""
    pixels = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    rel = lambda c: relative_path(F.col(c), root)
    images = pixels.select(rel("image.origin").alias("path"), "image", (F.col("image.height") <= 0).alias("corrupt"))
    listed = sizes.select(rel("path").alias("path"), (F.col("length") / 1024.0).alias("size_kb"))
    listed = listed.filter(extension(F.col("path")).isin(*IMAGE_EXTENSIONS) & ~is_hidden(F.col("path")))
    out = listed.join(images, "path", "left").withColumn("corrupt", F.coalesce("corrupt", F.lit(True)))
    return out.withColumn("label", F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit("")))


WAV = "path string, sample_rate int, channels int, bit_depth int, samples array<float>, status string"


def decode_wav(files: DataFrame) -> DataFrame:
    """(path, sample_rate, channels, bit_depth, samples, status) of files (path, content); samples are mono in [-1, 1]."""
    def decode(batches):
        import io
        import wave

        import numpy as np

        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"]):
                try:
                    with wave.open(io.BytesIO(raw)) as w:
                        rate, ch, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
                        body = w.readframes(w.getnframes())
                    if width == 1:
                        x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128.0) / 128.0
                    elif width == 3:
                        b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
                        x = (((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8) >> 8).astype(np.float32) / 8388608.0
                    else:
                        x = np.frombuffer(body, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(2 ** (8 * width - 1))
                    rows.append((path, rate, ch, 8 * width, x.reshape(-1, ch).mean(1).astype(np.float32), "ok"))
                except Exception as exc:
                    rows.append((path, 0, 0, 0, None, f"corrupt: {exc}"))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "bit_depth", "samples", "status"])

    return files.select("path", "content").mapInPandas(decode, WAV)


def read_audio(spark: SparkSession, root: str) -> DataFrame:
    """WAV files below a folder with their first folder as label; other files are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = raw.select(relative_path(F.col("path"), root).alias("path"), "content")
    files = files.filter(extension(F.col("path")).isin(*AUDIO_EXTENSIONS) & ~is_hidden(F.col("path")))
    out = decode_wav(files)
    return out.withColumn("label", F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(F.lit("")))


def listing_counts(files: DataFrame, supported: tuple[str, ...], path: str = "path") -> DataFrame:
    """One row: supported and unsupported files and names that occur more than once."""
    names = files.groupBy(F.substring_index(path, "/", -1).alias("name"), extension(F.col(path)).isin(*supported).alias("ok")).agg(F.count("*").alias("n"))
    return names.agg(
        F.coalesce(F.sum(F.when(F.col("ok"), F.col("n"))), F.lit(0)).alias("supported"),
        F.coalesce(F.sum(F.when(~F.col("ok"), F.col("n"))), F.lit(0)).alias("unsupported"),
        F.coalesce(F.sum(F.when(F.col("ok") & (F.col("n") > 1), F.col("n") - 1)), F.lit(0)).alias("duplicate_names"))
