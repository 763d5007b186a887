"""Embedding whitening by shifted Cholesky QR.

Vectors are put on an integer grid, x = floor(64 c) + 1000000, so that their count, sums and squared deviations are exact.
The model is fitted on the different grid vectors; all rows are projected.

* Rows are centred as (n x - S) / n, where n x - S is an integer; no square of an uncentred value is ever formed.
* Each pass solves the rows against the triangular factors found so far, sums the Gram matrix of what comes out over all
  rows, and takes the Cholesky factor of that matrix as the next one. A small shift keeps the first factors positive where
  columns depend on each other. Passes end when the Gram matrix is a projection: the identity, but for directions without
  variance.
* The factors multiplied together are R of a QR decomposition of the centred rows, so the singular values and right
  vectors of R are theirs: eigenvalues e = s^2 / n of the covariance, and its unit eigenvectors.

A task holds one block of rows and one d x d matrix; the driver holds d x d matrices, d being the length of the vectors.

Rows: those whose vector is NULL, empty, or holds NULL or non-finite entries are dropped. Vectors of different lengths, or
entries whose grid value is no long, are an error. Repeated rows are projected each and fitted once; a NULL key stays NULL.
Directions without variance (all of them if there is only one vector) have no component. Equal eigenvalues share a
space in which any basis is right. Each component's sign makes its largest entry positive. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

GRID, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows that a task solves at a time.
BLOCK = 4096
MAX_PASSES = 8
#: Largest entry by which the last Gram matrix may miss being a projection.
SETTLED = 1e-12


def on_grid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and x (array<long>) of the rows whose vector can be used."""
    v = F.col(vector)
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    usable = vectors.select(F.col(key), v).filter(v.isNotNull() & (F.size(v) > 0) & whole)
    return usable.select(F.col(key), F.transform(v, lambda c: F.floor(c.cast("double") * GRID) + OFFSET).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows x entries of a column of equally long lists."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and {sizes.max()} entries")
    return column.flatten().to_numpy().reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], at: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            part = batch.slice(k, BLOCK)
            yield part, _matrix(part.column(at))


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str, zero: Callable[[], np.ndarray]) -> np.ndarray:
    """Sum over all blocks of a matrix made of each; tasks send one matrix each, which are added up row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches):
            got = part(x)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total))], names=["i", "v"])

    partial = rows.select("x").mapInArrow(run, f"i int, v array<{kind}>")
    each = partial.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = zero()
    for r in each.collect():  # as many rows as the matrix has entries
        out[r["i"], r["j"]] = r["v"]
    return out


def solved(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows q with q R = a, for the upper triangular factors one after the other."""
    for r in factors:
        q = np.empty_like(a)
        for j in range(a.shape[1]):
            q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        a = q
    return a


@dataclass
class Whitening:
    """n different vectors with exact sums; eigenvalues of all directions with variance, and their components (columns)."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    passes: int = 0
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact; Python integers where a long could not hold it."""
        if x.size and (self.n > (1 << 62) // max(1, int(np.abs(x).max())) or int(np.abs(self.sums).max()) > 1 << 62):
            return x.astype(object) * self.n - self.sums.astype(object)
        return x * np.int64(self.n) - self.sums

    def project(self, x: np.ndarray, most: int = COMPONENTS) -> np.ndarray:
        v, e = self.components[:, :most], self.values[:most]
        return self.centred(x).astype(np.float64) / self.n @ v / np.sqrt(e)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        c = self.centred(x)
        if c.dtype != object and c.size and int(np.abs(c).max()) > int(((1 << 62) / c.shape[1]) ** 0.5):
            c = c.astype(object)
        return (c * c).sum(axis=1).astype(np.int64)  # an error beyond the range of a long


def fit(grid: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """The model of the different vectors x among the rows; None without any."""
    rows = cut_lineage(grid.select("x").distinct())
    head = rows.agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("d")).first()
    n, d = head["n"], head["d"]
    if not n:
        return None
    if head["least"] != d:
        raise ValueError(f"vectors of {head['least']} and {d} entries")
    sums = _summed(rows, lambda x: x.sum(axis=0, keepdims=True), "long", lambda: np.zeros((1, d), np.int64))[0]
    model = Whitening(n, sums, np.empty(0), np.empty((d, 0)), 0.0)
    factors: list[np.ndarray] = []

    def gram(found: list[np.ndarray]) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            q = solved(model.centred(x).astype(np.float64) / n, found)
            return q.T @ q

        g = _summed(rows, part, "double", lambda: np.zeros((d, d)))
        return (g + g.T) / 2

    g = gram(factors)
    model.passes = 1
    if not np.trace(g):
        return model
    spread = float(np.trace(g))
    while True:
        # the shift is the rounding error that the sum of the Gram matrix may hold; directions below it have no variance
        shift = 11 * d * (n + d + 1) * np.finfo(float).eps / 2 if not factors else d * np.finfo(float).eps
        factors.append(np.linalg.cholesky(g + min(shift, 1e-8) * np.linalg.norm(g, 2) * np.eye(d)).T)
        before, g = g, gram(factors)
        model.passes += 1
        if np.abs(g @ g - g).max() < SETTLED or model.passes == MAX_PASSES:
            break
    r = np.eye(d)
    for f in factors:
        r = f @ r
    rest, basis = np.linalg.eigh(g)  # the identity but for rounding and for directions without variance
    r = (basis * np.sqrt(np.maximum(rest, 0))).T @ r
    _, s, vt = np.linalg.svd(r)
    kept = s > s[0] * d * np.sqrt(np.finfo(float).eps) * 1e-3
    v = vt[kept].T
    model.values, model.trace = s[kept] ** 2 / n, spread / n
    model.components = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
    model.identity_error = _identity_error(rows, model, most)
    return model


def _identity_error(rows: DataFrame, model: Whitening, most: int) -> float:
    """Largest entry by which the covariance of the projected vectors misses the identity."""
    k = min(most, len(model.values))
    if not k:
        return 0.0

    def means(x: np.ndarray) -> np.ndarray:
        return model.project(x, most).sum(axis=0, keepdims=True)

    mean = _summed(rows, means, "double", lambda: np.zeros((1, k)))[0] / model.n

    def part(x: np.ndarray) -> np.ndarray:
        w = model.project(x, most) - mean
        return w.T @ w

    return float(np.abs(_summed(rows, part, "double", lambda: np.zeros((k, k))) / model.n - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component (from 1 by falling eigenvalue), n, deviation, whitened, explained, identity_error: a row for each usable
    vector and each of the first ``most`` components that have variance."""
    grid = on_grid(vectors, key, vector)
    model = fit(grid, most)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    k = min(most, len(model.values))
    explained = model.values[:k] / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, 1):
            rows = len(x)
            columns = [
                part.column(0).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)), pa.array(np.repeat(model.deviation(x), k)), pa.array(model.project(x, k).reshape(-1)),
                pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return grid.mapInArrow(run, schema)
