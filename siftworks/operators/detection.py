"""Scoring of detections against true boxes: overlaps by spatial join, greedy matching of all thresholds at once, mean AP."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ordering import running_totals
from .rows import side_by_side

BOX = ("x1", "y1", "x2", "y2")
THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)


def intersection(a: dict, b: dict) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return w * h


def area(a: dict) -> Column:
    return F.greatest(F.lit(0.0), a["x2"] - a["x1"]) * F.greatest(F.lit(0.0), a["y2"] - a["y1"])


def box_iou(a: dict, b: dict) -> Column:
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def overlaps(pred: DataFrame, truth: DataFrame, cell: float = 64.0) -> DataFrame:
    """(image_id, pred_id, score, truth_id, iou) of overlapping pairs only. Boxes meet in the grid cells they cover, so a
    crowded image is spread over many keys; a pair counts in the cell that holds the corner of its intersection."""
    def gridded(df, tag):
        def span(lo, hi):
            return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.greatest(F.col(lo), F.col(hi)) / cell))

        cols = [F.col(c).cast("double").alias(f"{tag}_{c}") for c in BOX]
        wide = df.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))
        return wide.select("image_id", "_cx", "_cy", F.col(f"{tag}_id"), *cols, *(["score"] if tag == "pred" else []))

    met = gridded(pred, "pred").join(gridded(truth, "truth"), ["image_id", "_cx", "_cy"])
    a, b = ({c: F.col(f"{t}_{c}") for c in BOX} for t in ("pred", "truth"))
    home = (F.floor(F.greatest(a["x1"], b["x1"]) / cell) == F.col("_cx")) & (F.floor(F.greatest(a["y1"], b["y1"]) / cell) == F.col("_cy"))
    iou = met.filter(home).withColumn("iou", box_iou(a, b)).filter("iou > 0")
    return iou.select("image_id", "pred_id", "score", "truth_id", "iou")


#: Pairs of an image up to which one task matches it in one fold; the rounds take larger images.
CROWDED_PAIRS = 1_000_000


def greedy_matches(pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS, crowded_pairs: int = CROWDED_PAIRS) -> DataFrame:
    """(threshold, image_id, pred_id, truth_id): predictions in score order each take their best free truth, at every
    threshold. Equal scores go by pred_id, equal overlaps by truth_id. Both ways of matching give the same rows."""
    whole, crowded = _by_crowd(pairs, thresholds, crowded_pairs)
    found = folded_matches(whole, thresholds)
    return found if crowded is None else found.unionByName(settled_matches(crowded, thresholds))


def matched_levels(pairs: DataFrame, thresholds: Sequence[float] = THRESHOLDS, crowded_pairs: int = CROWDED_PAIRS) -> DataFrame:
    """(image_id, pred_id, levels): one row per matched prediction, a bit for every threshold at which it is matched."""
    whole, crowded = _by_crowd(pairs, thresholds, crowded_pairs)
    found = folded_levels(whole).select("image_id", "pred_id", "levels")
    if crowded is not None:
        bit = sum(F.when(F.col("threshold") == float(t), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(thresholds))
        found = found.unionByName(settled_matches(crowded, thresholds).select("image_id", "pred_id", bit.alias("levels")))
    return found.groupBy("image_id", "pred_id").agg(F.bit_or("levels").alias("levels"))


def _by_crowd(pairs: DataFrame, thresholds: Sequence[float], crowded_pairs: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs with their levels: those of images that one task matches, those of larger images if there are any."""
    masked = cut_lineage(pairs.withColumn("levels", sum(F.when(F.col("iou") >= float(t), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(thresholds))).filter("levels > 0"))
    crowded = cut_lineage(masked.groupBy("image_id").agg(F.count("*").alias("n")).filter(F.col("n") > crowded_pairs).select("image_id"))
    if crowded.isEmpty():
        return masked, None
    return masked.join(crowded, "image_id", "left_anti"), masked.join(crowded, "image_id", "left_semi")


def folded_matches(masked: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """The matches of whole images, a row per threshold."""
    return folded_levels(masked).withColumn("threshold", explode_levels(thresholds)).select("threshold", "image_id", "pred_id", "truth_id")


def folded_levels(masked: DataFrame) -> DataFrame:
    """The matches of whole images with a bit per threshold. Pairs stream through a task in the order in which predictions choose; kept are one
    bit per threshold for each truth of the image at hand and for the prediction at hand."""
    ordered = masked.select("image_id", "score", "pred_id", "truth_id", "iou", "levels").repartition("image_id").sortWithinPartitions(
        "image_id", F.desc("score"), "pred_id", F.desc("iou"), "truth_id").select("image_id", "pred_id", "truth_id", "levels")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chooser, taken, wanted = None, None, {}, 0
        for batch in batches:
            rows, given = [], []
            for i, (image, pred, truth, levels) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                if (image,) != at:
                    at, chooser, taken = (image,), None, {}
                if (pred,) != chooser:
                    chooser, wanted = (pred,), -1
                got = wanted & levels & ~taken.get(truth, 0)
                if got:
                    taken[truth] = taken.get(truth, 0) | got
                    wanted &= ~got
                    rows.append(i)
                    given.append(got)
            out = batch.take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(given, pa.int32())], schema=pa.schema([*list(batch.schema)[:3], pa.field("levels", pa.int32())]))

    return ordered.mapInArrow(fold, ordered.schema)


def explode_levels(thresholds: Sequence[float]) -> Column:
    hit = [F.when(F.col("levels").bitwiseAND(F.lit(1 << i)) != 0, F.lit(float(t))) for i, t in enumerate(thresholds)]
    return F.explode(F.array_compact(F.array(*hit)))


def settled_matches(masked: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """The matches of images of any size, in rounds. A prediction is settled as soon as no better-scored open prediction
    could still want its best free truth. All settled ones are taken in one round, so the rounds follow the longest chain of
    rivals, not the number of boxes; every round settles at least one."""
    order = F.struct(-F.col("score"), F.col("pred_id"))
    best = F.struct(F.col("iou"), -F.col("truth_id"))
    open_pairs = cut_lineage(masked.withColumn("threshold", explode_levels(thresholds)))
    key = ["threshold", "image_id"]
    done = None
    while True:
        wish = open_pairs.groupBy(*key, "pred_id").agg(F.max_by("truth_id", best).alias("truth_id"))
        first = open_pairs.groupBy(*key, "truth_id").agg(F.min_by("pred_id", order).alias("_first"))
        settled = cut_lineage(wish.join(first, [*key, "truth_id"]).filter(F.col("pred_id") == F.col("_first")).drop("_first"))
        if settled.isEmpty():
            break
        done = settled if done is None else done.unionByName(settled)
        rest = open_pairs.join(settled.select(*key, "pred_id"), [*key, "pred_id"], "left_anti")
        open_pairs = cut_lineage(rest.join(settled.select(*key, "truth_id"), [*key, "truth_id"], "left_anti"))
    return (open_pairs if done is None else done).select(*key, "pred_id", "truth_id")


def detection_metrics(pred: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS, cell: float = 64.0) -> DataFrame:
    """map, map_50, map_75, precision and recall at 0.5, and the mean best overlap per image."""
    pairs = cut_lineage(overlaps(pred, truth, cell))
    levels = matched_levels(pairs, thresholds)
    flagged = pred.select("image_id", "pred_id", "score").join(levels, ["image_id", "pred_id"], "left")
    flagged = flagged.withColumn("levels", F.coalesce("levels", F.lit(0)))
    n_truth = float(truth.count())
    # all thresholds rank the predictions alike: one order, a running total per threshold
    hits = [F.when(F.col("levels").bitwiseAND(F.lit(1 << i)) != 0, 1).otherwise(0) for i in range(len(thresholds))]
    sums = {f"tp{i}": hit for i, hit in enumerate(hits)} | {"seen": F.lit(1)}
    cum = running_totals(flagged, [F.desc("score"), F.col("image_id"), F.col("pred_id")], sums)
    per = cum.agg(*[c for i, hit in enumerate(hits) for c in (
        F.sum(hit * F.col(f"tp{i}") / F.col("seen") / n_truth).alias(f"ap{i}"),
        (F.sum(hit) / F.count("*")).alias(f"precision{i}"), (F.sum(hit) / n_truth).alias(f"recall{i}"))])
    at = {t: next((i for i, u in enumerate(thresholds) if abs(u - t) < 1e-9), None) for t in (0.5, 0.75)}
    scores = per.select((sum(F.col(f"ap{i}") for i in range(len(thresholds))) / len(thresholds)).alias("map"), *[
        (F.lit(None).cast("double") if at[t] is None else F.col(f"{c}{at[t]}")).alias(n) for n, t, c in (
            ("map_50", 0.5, "ap"), ("map_75", 0.75, "ap"), ("precision", 0.5, "precision"), ("recall", 0.5, "recall"))])
    both = pred.select("image_id").distinct().join(truth.select("image_id").distinct(), "image_id")
    best = both.join(pairs.groupBy("image_id").agg(F.max("iou").alias("iou")), "image_id", "left")
    mean = best.agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("mean_iou"))
    return side_by_side(scores, mean)
