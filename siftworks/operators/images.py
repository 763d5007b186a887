"""Image operators on the image source's rows and on gray arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import side_by_side

# Luma weights (the image source stores blue, green, red), profile thresholds, histogram bins.
LUMA = (0.114, 0.587, 0.299)
SMALL, LARGE = 32, 1024
OTSU_BINS = 64


def _array(height: int, width: int, channels: int, data) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)


def _gray(px: np.ndarray) -> np.ndarray:
    return px[..., 0] if px.shape[2] == 1 else px[..., :3] @ np.array(LUMA)


@F.pandas_udf(T.StructType([T.StructField("brightness", T.DoubleType()), T.StructField("contrast", T.DoubleType())]))
def gray_stats(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Mean and deviation of the luma in [0, 1]."""
    rows = []
    for h, w, c, d in zip(height, width, channels, data):
        g = _gray(_array(h, w, c, d)) if h and h > 0 else np.array([np.nan])
        rows.append((g.mean() / 255.0, g.std() / 255.0))
    return pd.DataFrame(rows, columns=["brightness", "contrast"])


def image_profile(images: DataFrame) -> DataFrame:
    """One row: sizes, aspect, channels, brightness, contrast, file sizes, corrupt count and the quality flags."""
    i = F.col("image")
    ok = images.filter("NOT corrupt").withColumn("s", gray_stats(i["height"], i["width"], i["nChannels"], i["data"]))
    h, w, ch = i["height"].cast("double"), i["width"].cast("double"), i["nChannels"]
    one = ok.agg(
        F.count("*").alias("n_valid"),
        *[g(c).alias(f"{p}_{n}") for n, c in (("height", h), ("width", w)) for p, g in (("avg", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))],
        F.avg(w / h).alias("avg_aspect_ratio"), F.stddev_pop(w / h).alias("aspect_ratio_std"), F.mode(ch).alias("dominant_channels"),
        F.avg((ch == 1).cast("int")).alias("grayscale_ratio"), F.avg((ch == 4).cast("int")).alias("rgba_ratio"),
        F.avg("s.brightness").alias("avg_brightness"), F.stddev_pop("s.brightness").alias("brightness_std"),
        F.avg("s.contrast").alias("avg_contrast"), F.stddev_pop("s.contrast").alias("contrast_std"))
    files = images.agg(
        F.count("*").alias("n_images"), F.count_if("corrupt").alias("n_corrupt"),
        *[g("size_kb").alias(f"{p}_file_size_kb") for p, g in (("avg", F.avg), ("min", F.min), ("max", F.max))])
    out = side_by_side(one, files)
    spread = (F.col("std_height") / F.greatest("avg_height", F.lit(1.0)) + F.col("std_width") / F.greatest("avg_width", F.lit(1.0))) / 2
    return out.withColumns({
        "has_varied_sizes": spread > 0.15, "is_uniform_size": (F.col("std_height") < 1) & (F.col("std_width") < 1),
        "has_low_contrast": F.col("avg_contrast") < 0.10, "has_high_contrast_variance": F.col("contrast_std") > 0.08,
        "has_varied_brightness": F.col("brightness_std") > 0.15, "has_grayscale_images": F.col("grayscale_ratio") > 0,
        "has_mostly_grayscale": F.col("grayscale_ratio") > 0.5, "has_rgba_images": F.col("rgba_ratio") > 0,
        "has_small_images": (F.col("min_height") < SMALL) | (F.col("min_width") < SMALL),
        "has_large_images": (F.col("max_height") > LARGE) | (F.col("max_width") > LARGE), "has_corrupt_images": F.col("n_corrupt") > 0})


@dataclass(frozen=True)
class ImageSpec:
    resize: int = 64
    color_mode: str = "rgb"
    normalization: str = "standard"
    histogram_eq: bool = False
    denoise: bool = False
    sharpen: bool = False


BLUR = np.outer([1, 2, 1], [1, 2, 1]) / 16.0
SHARPEN = np.array([[-2, -2, -2], [-2, 32, -2], [-2, -2, -2]]) / 16.0


def _filter(px: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    p = np.pad(px, ((1, 1), (1, 1), (0, 0)), mode="edge")
    h, w = px.shape[:2]
    return np.clip(sum(kernel[a, b] * p[a:a + h, b:b + w] for a in range(3) for b in range(3)), 0, 255)


def _resize(px: np.ndarray, n: int) -> np.ndarray:
    def grid(size):
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        lo = np.floor(at).astype(int)
        return lo, np.minimum(lo + 1, size - 1), at - lo

    (a, b, u), (c, d, v) = grid(px.shape[0]), grid(px.shape[1])
    u, v = u[:, None, None], v[None, :, None]
    return (px[a][:, c] * (1 - u) + px[b][:, c] * u) * (1 - v) + (px[a][:, d] * (1 - u) + px[b][:, d] * u) * v


def _equalize(px: np.ndarray) -> np.ndarray:
    out = np.empty_like(px)
    for ch in range(px.shape[2]):
        level = np.clip(np.rint(px[..., ch]), 0, 255).astype(int)
        cum = np.cumsum(np.bincount(level.ravel(), minlength=256))
        low = cum[cum > 0][0]
        out[..., ch] = np.rint((cum[level] - low) / max(cum[-1] - low, 1) * 255)
    return out


def standardized(images: DataFrame, spec: ImageSpec, out: str = "pixels") -> DataFrame:
    """Flat pixel array after color, size, equalisation, blur, sharpening and per-image scaling. Resizing is bilinear."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
        rows = []
        for h, w, c, d in zip(height, width, channels, data):
            px = _array(h, w, c, d)
            px = _gray(px)[..., None] if spec.color_mode == "grayscale" else (np.repeat(px, 3, axis=2) if c == 1 else px[..., 2::-1])
            if spec.resize > 0:
                px = _resize(px, spec.resize)
            if spec.histogram_eq:
                px = _equalize(px)
            if spec.denoise:
                px = _filter(px, BLUR)
            if spec.sharpen:
                px = _filter(px, SHARPEN)
            if spec.normalization == "standard":
                px = (px - px.mean()) / (px.std() or 1.0)
            elif spec.normalization == "minmax":
                px = (px - px.min()) / ((px.max() - px.min()) or 1.0)
            rows.append(px.ravel())
        return pd.Series(rows)

    i = F.col("image")
    return images.filter("NOT corrupt").withColumn(out, run(i["height"], i["width"], i["nChannels"], i["data"]))


def otsu_thresholds(df: DataFrame, key: str, gray: str, bins: int = OTSU_BINS) -> DataFrame:
    """(key, threshold): the bin centre with the largest between-class variance. Pixels are counted per bin before anything
    is grouped by image, so an image is at most ``bins`` rows."""
    lo, hi = F.array_min(gray).cast("double"), F.array_max(gray).cast("double") + 1e-6
    px = df.select(key, lo.alias("lo"), hi.alias("hi"), F.explode(gray).alias("v"))
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    hist = px.groupBy(key, "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    every = hist.groupBy(key, "lo", "hi").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    full = every.select(key, "lo", "hi", "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = full.withColumn("n", F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0))).withColumn(
        "centre", F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + 0.5) / bins)
    w = Window.partitionBy(key).orderBy("bin")
    whole = Window.partitionBy(key)
    # Centres are evenly spaced, so the variance is (s0 * t - s * c)^2 / (c * (t - c)) up to a factor that an image's bins
    # share, with sums of whole numbers: equal variances compare as equal, and the lowest bin of them is taken.
    cum = full.withColumns({
        "c": F.sum("n").over(w), "s0": F.sum(F.col("n") * F.col("bin")).over(w), "t": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("bin")).over(whole)})
    apart = (F.col("s0") * F.col("t") - F.col("s") * F.col("c")).cast("decimal(19,0)")
    sides = (F.col("c") * (F.col("t") - F.col("c"))).cast("decimal(19,0)")
    var = F.when((F.col("c") > 0) & (F.col("c") < F.col("t")) & (F.col("bin") < bins - 1), apart * apart / sides)
    return cum.withColumn("var", F.coalesce(var, F.lit(-1))).groupBy(key).agg(
        F.max_by("centre", F.struct("var", -F.col("bin"))).alias("threshold"))


def mask_scores(pred: Column, truth: Column) -> Column:
    """IoU, dice, pixel accuracy, precision and recall of two 0/1 arrays."""
    def count(test):
        return F.aggregate(F.zip_with(pred, truth, test), F.lit(0.0), lambda s, v: s + v)

    inter, p, t = count(lambda a, b: a * b), count(lambda a, b: a + 0 * b), count(lambda a, b: b + 0 * a)
    same = count(lambda a, b: F.when(a == b, 1).otherwise(0))

    def part(x, y):
        return F.when(y > 0, x / y).otherwise(F.lit(0.0))

    return F.struct(
        part(inter, p + t - inter).alias("mean_iou"), part(2 * inter, p + t).alias("dice_score"), (same / F.size(truth)).alias("pixel_accuracy"),
        part(inter, p).alias("precision"), part(inter, t).alias("recall"))


def segmentation_metrics(df: DataFrame, key: str, gray: str, truth: str) -> DataFrame:
    """Otsu baseline in the better polarity per image, averaged over images."""
    both = df.select(key, gray, truth).join(otsu_thresholds(df, key, gray), key)
    up = F.transform(gray, lambda v: (v > F.col("threshold")).cast("int"))
    down = F.transform(gray, lambda v: (v <= F.col("threshold")).cast("int"))
    scored = both.withColumn("_a", mask_scores(up, F.col(truth))).withColumn("_b", mask_scores(down, F.col(truth)))
    best = F.when(F.col("_a.mean_iou") >= F.col("_b.mean_iou"), F.col("_a")).otherwise(F.col("_b"))
    return scored.select(best.alias("m")).agg(*[F.avg(f"m.{c}").alias(c) for c in ("mean_iou", "pixel_accuracy", "dice_score")])
