"""Topics by non-negative factorisation of the TF-IDF matrix, fitted on every document.

X is approximated by W H, W with a row per document and H with a row per topic. H fits on one machine (topics times a
bounded vocabulary), W never has to: for a given H each document's weights are found on their own, and W'W and W'X, summed
over all documents, are all that the next H needs. One job per pass does both, and yields the exact error as well, so
passes go on until the error stops falling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import Block, blocks, summed

SWEEPS = 30
POWER_PASSES = 4
TOLERANCE = 1e-4
MAX_PASSES = 300


def coordinate_sweeps(w: np.ndarray, target: np.ndarray, gram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Rows w >= 0 that lessen w gram w' - 2 w target', one coordinate after the other."""
    w = w.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(gram)):
            if gram[j, j] > 0:
                new = np.maximum(w[:, j] + (target[:, j] - w @ gram[:, j]) / gram[j, j], 0.0)
                moved = max(moved, float(np.abs(new - w[:, j]).max(initial=0.0)))
                w[:, j] = new
        if moved < 1e-10:
            break
    return w


def weights(block: Block, h: np.ndarray) -> np.ndarray:
    """The topic weights of a block's documents."""
    target = block.times(h.T)
    return coordinate_sweeps(np.zeros_like(target), target, h @ h.T)


@dataclass
class TopicModel:
    """h: topics x terms. ``errors`` has the squared error of X - W H after every pass; the last h goes with the last."""

    h: np.ndarray
    errors: list[float] = field(default_factory=list)

    def transform(self, rows: DataFrame, key: str, topic: str = "weights", carry: Sequence[str] = ()) -> DataFrame:
        """key, the columns of ``carry`` and the topic weights of every row of (key, indices, values)."""
        h, names = self.h, [key, *carry]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, block in blocks(batches):
                yield pa.RecordBatch.from_arrays([*block.extra, pa.array(list(weights(block, h)), pa.list_(pa.float64()))], names=[*names, topic])

        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
        return rows.select("indices", "values", *names).mapInArrow(run, f"{kinds}, `{topic}` array<double>")


def first_topics(rows: DataFrame, k: int, terms: int, mean: float, seed: int) -> np.ndarray:
    """Starting topics: leading right singular vectors by power passes over all rows, the stronger sign of each, their
    zeros filled with the mean of X."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(terms, min(terms, k + 5))))[0]
    for _ in range(POWER_PASSES):

        def fold(parts: Iterator[Block], q: np.ndarray = q) -> np.ndarray:
            total = np.zeros_like(q)
            for b in parts:
                b.add_transposed_times(b.times(q), total)
            return total.T

        z = summed(rows, fold).T
        q, r = np.linalg.qr(z)
    u, s, _ = np.linalg.svd(r)
    v = (q @ u)[:, :k].T * np.sqrt(np.sqrt(s[:k]))[:, None]
    up, down = np.maximum(v, 0.0), np.maximum(-v, 0.0)
    h = np.where(((up**2).sum(1) >= (down**2).sum(1))[:, None], up, down)
    return np.where(h > 0, h, mean)


def fit(rows: DataFrame, k: int, terms: int, seed: int = 42, tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES) -> TopicModel:
    """Topics of all rows of (indices, values). Passes end when one lessens the error by less than ``tolerance`` of the
    first error."""
    rows = cut_lineage(rows.select("indices", "values"))
    size = rows.agg(
        F.count("*").alias("n"), F.sum(F.aggregate("values", F.lit(0.0), lambda s, v: s + v)).alias("total"),
        F.sum(F.aggregate("values", F.lit(0.0), lambda s, v: s + v * v)).alias("squares"),
    ).first()
    if not size["n"] or not size["squares"]:
        return TopicModel(np.zeros((k, terms)), [0.0])
    model = TopicModel(first_topics(rows, k, terms, size["total"] / size["n"] / terms, seed))
    while True:
        h = model.h

        def fold(parts: Iterator[Block], h: np.ndarray = h) -> np.ndarray:
            gram, cross = np.zeros((len(h), len(h))), np.zeros((h.shape[1], len(h)))
            for b in parts:
                w = weights(b, h)
                gram += w.T @ w
                b.add_transposed_times(w, cross)
            return np.hstack([gram, cross.T])

        both = summed(rows, fold)
        gram, cross = both[:, : len(h)], both[:, len(h) :]
        model.errors.append(float(size["squares"] - 2 * (cross * h).sum() + (gram * (h @ h.T)).sum()))
        done = len(model.errors) > 1 and model.errors[-2] - model.errors[-1] < tolerance * model.errors[0]
        if done or len(model.errors) == max_passes:
            return model
        model.h = coordinate_sweeps(h.T, cross.T, gram).T


def silhouette(weighted: DataFrame, vec: str, group: str, n_groups: int) -> DataFrame:
    """(metric, value): mean silhouette with squared Euclidean distances. The mean squared distance of a row to a group
    follows from the group's size, sum and sum of squares, so no pair of rows is looked at. Rows alone in their group
    count as 0; with fewer than two groups the value is 0."""
    d = (weighted.select(F.size(vec)).first() or [0])[0]
    sums = weighted.groupBy(group).agg(
        F.count("*").alias("n"), F.array(*[F.sum(F.col(vec)[i]) for i in range(d)]).alias("s"),
        F.sum(F.aggregate(vec, F.lit(0.0), lambda a, v: a + v * v)).alias("q"))
    found = {r[group]: r for r in sums.limit(n_groups + 1).collect()}
    if len(found) < 2:
        return weighted.sparkSession.createDataFrame([("silhouette", 0.0)], "metric string, value double")
    own_square = F.aggregate(F.col(vec), F.lit(0.0), lambda a, v: a + v * v)

    def total(r) -> Column:
        dot = sum((F.col(vec)[i] * F.lit(r["s"][i]) for i in range(d)), F.lit(0.0))
        return F.greatest(r["n"] * own_square - 2 * dot + F.lit(r["q"]), F.lit(0.0))

    mine = F.coalesce(*[F.when(F.col(group) == F.lit(g), total(r) / max(r["n"] - 1, 1)) for g, r in found.items()])
    single = F.coalesce(*[F.when(F.col(group) == F.lit(g), F.lit(r["n"] == 1)) for g, r in found.items()])
    other = F.array_min(F.array(*[F.when(F.col(group) != F.lit(g), total(r) / r["n"]) for g, r in found.items()]))
    value = F.when(F.col("_s") | (F.greatest("_a", "_b") == 0), F.lit(0.0)).otherwise((F.col("_b") - F.col("_a")) / F.greatest("_a", "_b"))
    return weighted.select(mine.alias("_a"), other.alias("_b"), single.alias("_s")).agg(F.lit("silhouette").alias("metric"), F.avg(value).alias("value"))
