"""Fits that pass over all rows: topics, many labels at once; compared with plain numpy."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from siftworks.operators import blocks, linear, topics


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(6)
    w = rng.gamma(0.5, 1.0, (90, 3))
    x = w @ rng.gamma(0.3, 1.0, (3, 40)) + rng.random((90, 40)) * 0.05
    return np.where(x > 0.3, x, 0.0)


def rows_of(spark, x, **more):
    made = []
    for i, r in enumerate(x):
        at = np.flatnonzero(r)
        made.append((i, [int(a) for a in at], [float(v) for v in r[at]], *[v[i] for v in more.values()]))
    return spark.createDataFrame(made, "id long, indices array<int>, values array<double>" + "".join(f", {k} array<int>" for k in more)).repartition(4)


def test_blocks_multiply_like_matrices(spark, matrix):
    m = np.random.default_rng(1).normal(size=(40, 5))
    rows = rows_of(spark, matrix)

    def fold(parts):
        total = np.zeros((40, 5))
        for b in parts:
            b.add_transposed_times(b.times(m), total)
        return total.T

    for entries in (7, 200_000):
        assert np.allclose(blocks.summed(rows.select("indices", "values"), fold, entries).T, matrix.T @ matrix @ m)


def test_sparse_parts_of_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0, 0.0]), (2, [])], "id long, v array<double>").withColumn("v", array_to_vector("v"))
    got = {r["id"]: (r["indices"], r["values"]) for r in df.select("id", *blocks.sparse_parts("v")).collect()}
    assert got == {1: ([0, 1, 2], [0.0, 2.0, 0.0]), 2: ([], [])}


def test_topics_see_every_row_and_reach_the_error_of_a_plain_factorisation(spark, matrix):
    rows = rows_of(spark, matrix)
    model = topics.fit(rows, 3, 40, tolerance=1e-6)
    assert all(a >= b - 1e-9 for a, b in zip(model.errors, model.errors[1:]))
    got = {r["id"]: r["weights"] for r in model.transform(rows, "id").collect()}
    w = np.array([got[i] for i in range(len(matrix))])
    assert (w >= 0).all() and (model.h >= 0).all()
    assert abs(((matrix - w @ model.h) ** 2).sum() - model.errors[-1]) < 1e-6 * model.errors[0]
    best = min(_plain(matrix, 3, seed) for seed in range(5))
    assert model.errors[-1] <= best * 1.02
    assert topics.fit(rows.limit(0), 3, 40).errors == [0.0]


def _plain(x, k, seed):
    """Multiplicative updates from a random start."""
    rng = np.random.default_rng(seed)
    w, h = rng.random((len(x), k)), rng.random((k, x.shape[1]))
    for _ in range(3000):
        h *= (w.T @ x) / np.maximum(w.T @ w @ h, 1e-12)
        w *= (x @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
    return ((x - w @ h) ** 2).sum()


def test_silhouette_of_topics_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.gamma(0.4, 1.0, (60, 4))
    x[10:14] = x[9]
    label = x.argmax(1)
    label[0] = 9  # alone in its group
    gap = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = []
    for i in range(len(x)):
        own = [j for j in np.flatnonzero(label == label[i]) if j != i]
        if not own:
            want.append(0.0)
            continue
        a = gap[i, own].mean()
        b = min(gap[i, label == g].mean() for g in set(label.tolist()) - {label[i]})
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([([float(v) for v in r], int(g)) for r, g in zip(x, label)], "w array<double>, topic int")
    assert abs(topics.silhouette(df, "w", "topic", 10).first()["value"] - np.mean(want)) < 1e-9
    assert topics.silhouette(df.filter("topic = 9"), "w", "topic", 10).first()["value"] == 0


def _separate(x, positive, loss, weights, steps=20_000):
    """One label by plain gradient descent with a fixed step; returns the objective."""
    w, b = np.zeros(x.shape[1]), 0.0
    side = np.where(positive, weights[1], weights[0])
    step = 1 / (1 + 2 * (side[:, None] * (x**2 + 1)).sum())
    of, small = linear.LOSSES[loss]
    momentum, v, vb, at = 0.0, w.copy(), b, 1.0
    for _ in range(steps):
        f, d = of(x @ v + vb, positive)
        d = d * side
        new_w, new_b = v - step * (x.T @ d + v), vb - step * (d.sum() + small * vb)
        nxt = (1 + np.sqrt(1 + 4 * at**2)) / 2
        momentum = (at - 1) / nxt
        v, vb, at = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b), nxt
        w, b = new_w, new_b
    return w, b


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge"])
@pytest.mark.parametrize("balance", [False, True])
def test_labels_fitted_together_equal_separate_fits(spark, monkeypatch, loss, balance):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((120, 9)) < 0.4, rng.random((120, 9)), 0.0)
    truth = (x @ rng.normal(size=(9, 5)) + rng.normal(scale=0.3, size=(120, 5)) > 0.2).astype(int)
    truth[:, 4] = rng.random(120) < 0.05
    rows = rows_of(spark, x, y=[[int(j) for j in np.flatnonzero(r)] for r in truth])
    monkeypatch.setattr(linear, "GROUP_WEIGHTS", 30)  # three labels at a time
    model = linear.fit(rows, 9, 5, loss, balance=balance, tolerance=1e-5)
    for j in range(5):
        p = truth[:, j].sum()
        weights = (120 / (2 * (120 - p)), 120 / (2 * p)) if balance else (1.0, 1.0)
        w, b = _separate(x, truth[:, j] == 1, loss, weights)
        assert np.allclose(model.weights[j], w, atol=5e-3) and abs(model.intercepts[j] - b) < 5e-3
    got = {r["id"]: r["pred"] for r in model.predict(rows, "id").collect()}
    margin = x @ model.weights.T + model.intercepts
    assert all(got[i] == np.flatnonzero(margin[i] > 0).tolist() for i in range(120))
    assert model.passes < 400


@pytest.mark.parametrize("loss", ["logistic", "squared_hinge"])
def test_columns_of_unlike_weight_do_not_multiply_the_passes(spark, loss):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 30)) * np.logspace(1, -1, 30)
    y = (x @ (rng.normal(size=30) / np.logspace(1, -1, 30)) > 0).astype(int)
    rows = spark.createDataFrame([(list(range(30)), v.tolist(), [0] if p else []) for v, p in zip(x, y)], "indices array<int>, values array<double>, y array<int>")
    model = linear.fit(rows, 30, 1, loss)
    assert model.passes < 40
