"""Anomaly detectors and density clustering: isolation forest, local outlier factor, DBSCAN."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import neighbours

SUBSAMPLE = 256
TREES = 100


def path_constant(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng, depth: int, limit: int, nodes: list) -> int:
    """Appends (feature, cut, left, right, depth value) and returns the node's index."""
    at = len(nodes)
    nodes.append(None)
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else np.array([], dtype=int)
    if depth >= limit or not len(spread):
        nodes[at] = (-1, 0.0, -1, -1, depth + path_constant(len(x)))
        return at
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] < cut
    left = _grow(x[low], rng, depth + 1, limit, nodes)
    right = _grow(x[~low], rng, depth + 1, limit, nodes)
    nodes[at] = (f, cut, left, right, 0.0)
    return at


def isolation_forest(df: DataFrame, key: str, vec: str, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 42) -> DataFrame:
    """Adds ``score`` (larger is more isolated). Each tree takes the rows with the smallest hashes of (key, tree); it is
    grown from at most ``subsample`` rows, so the whole forest is small and is sent to the scoring tasks."""
    n = df.count()
    take = min(subsample, n)
    bar = min(1.0, 2.0 * take / max(n, 1))
    unit = F.lit(2.0**63)
    picked = df.select(vec, F.explode(F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.abs(F.xxhash64(F.col(key), t, F.lit(seed)) / unit).alias("u"))),
        lambda s: s["u"] <= bar)).alias("s")).select("s.tree", "s.u", vec)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack([np.asarray(v, dtype=float) for v in pdf.sort_values("u")[vec].iloc[:take]])
        nodes: list = []
        _grow(x, np.random.default_rng(seed * 100_003 + tree), 0, max(1, math.ceil(math.log2(max(len(x), 2)))), nodes)
        return pd.DataFrame({"tree": [tree], "nodes": [[list(map(float, r)) for r in nodes]]})

    forest = [np.array([list(r) for r in row["nodes"]]) for row in picked.groupBy("tree").applyInPandas(grow, "tree int, nodes array<array<double>>").collect()]
    usual = path_constant(take) or 1.0

    from pyspark.sql import types as T

    @F.pandas_udf(T.DoubleType())
    def isolation(v: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(r, dtype=float) for r in v]) if len(v) else np.zeros((0, 1))
        total = np.zeros(len(x))
        for t in forest:
            at = np.zeros(len(x), dtype=int)
            while True:
                f = t[at, 0].astype(int)
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                low = x[inner, f[inner]] < t[at[inner], 1]
                at[inner] = np.where(low, t[at[inner], 2], t[at[inner], 3]).astype(int)
            total += t[at, 4]
        return pd.Series(2.0 ** (-(total / len(forest)) / usual))

    return df.withColumn("score", isolation(F.col(vec)))


def local_outlier_factor(df: DataFrame, key: str, vec: str, k: int = 20, **limits) -> DataFrame:
    """(key, score): mean local density of the neighbours over the own one, from the exact kNN graph."""
    edges = cut_lineage(neighbours.nearest(df, key, vec, k, **limits))
    reach = edges.groupBy(key).agg(F.max("distance").alias("kdist"))
    near = reach.select(F.col(key).alias("neighbour"), F.col("kdist").alias("nk"))
    dens = edges.join(near, "neighbour").groupBy(key).agg((1.0 / (F.avg(F.greatest("nk", "distance")) + 1e-10)).alias("lrd"))
    other = dens.select(F.col(key).alias("neighbour"), F.col("lrd").alias("nl"))
    return edges.select(key, "neighbour").join(other, "neighbour").groupBy(key).agg(F.avg("nl").alias("nl")).join(dens, key).select(
        key, (F.col("nl") / F.col("lrd")).alias("score"))


def dbscan(df: DataFrame, key: str, vec: str, eps: float = 0.7, min_samples: int | None = None, **limits) -> DataFrame:
    """(key, cluster) of density clusters, see neighbours.density_clusters; noise is -1."""
    return neighbours.density_clusters(df, key, vec, eps, min_samples or max(3, min(8, df.count() // 20 or 3)), **limits)
