"""The neighbour index against brute force: ties, copies, groups, missing values, and how little is compared."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftworks.operators import components, detectors, features, linear, metrics, neighbours, pairwise, vectors


def frame(spark, x, keys=None):
    return spark.createDataFrame([(int(k), [float(v) for v in r]) for k, r in zip(keys if keys is not None else range(len(x)), x)], "id long, v array<double>").repartition(3)


def brute_nearest(x, k):
    out = set()
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        others = sorted((float(d[j]), j) for j in range(len(x)) if j != i)[:k]
        out |= {(i, j, r) for r, (_, j) in enumerate(others, 1)}
    return out


@pytest.mark.parametrize("block_rows", [8, 1024])
def test_nearest_with_ties_and_copies(spark, block_rows):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (150, 2)).astype(float)  # a grid: many equal distances
    x[40:90] = x[3]  # a third of all rows are copies of one
    got = {(r["id"], r["neighbour"], r["rank"]) for r in neighbours.nearest(frame(spark, x), "id", "v", 4, block_rows).collect()}
    assert got == brute_nearest(x, 4)


def test_few_pairs_are_compared_in_clustered_rows(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in rng.uniform(-60, 60, (20, 3))])
    found, compared = neighbours.nearest_counted(frame(spark, x), "id", "v", 5, 20)
    assert {(r["id"], r["neighbour"], r["rank"]) for r in found.collect()} == brute_nearest(x, 5)
    assert compared < len(x) ** 2 / 6


def test_fewer_rows_than_neighbours_and_none(spark):
    x = np.array([[0.0], [1.0], [3.0]])
    assert {(r["id"], r["neighbour"], r["rank"]) for r in neighbours.nearest(frame(spark, x), "id", "v", 10).collect()} == brute_nearest(x, 10)
    assert neighbours.nearest(frame(spark, x[:1]), "id", "v", 2).collect() == []
    assert neighbours.nearest(frame(spark, x).limit(0), "id", "v", 2).collect() == []


def test_density_clusters_of_a_long_chain_and_copies(spark):
    """A chain of 300 points would need many rounds of spreading labels; copies count as often as they stand."""
    x = np.concatenate([np.stack([np.arange(300) * 0.5, np.zeros(300)], 1), np.full((4, 2), 500.0), [[505.0, 0.0]], [[149.5 + 0.6, 0.0]]])
    got = {r["id"]: r["cluster"] for r in neighbours.density_clusters(frame(spark, x, range(10, 316)), "id", "v", 0.6, 3, 16).collect()}
    assert {got[i] for i in range(10, 310)} == {11} and {got[i] for i in range(310, 314)} == {310}
    assert got[314] == -1 and got[315] == 11


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in (400, 450, 500)} == {400}


def brute_fill(x, donors, k):
    """NaN-aware distances to all donors; donors sorted by their values with missing ones first."""
    order = sorted(range(len(donors)), key=lambda i: [(not np.isnan(v), v if not np.isnan(v) else 0) for v in donors[i]])
    donors = donors[order]
    have = ~np.isnan(donors)
    out = x.copy()
    for i in np.flatnonzero(np.isnan(x).any(1)):
        both = have & ~np.isnan(x[i])
        seen = both.sum(1)
        d = np.where(seen > 0, np.sqrt(np.where(both, donors - np.nan_to_num(x[i]), 0) ** 2 @ np.ones(x.shape[1]) * x.shape[1] / np.maximum(seen, 1)), np.inf)
        for j in np.flatnonzero(np.isnan(x[i])):
            pool = [m for m in range(len(donors)) if have[m, j] and np.isfinite(d[m])]
            near = sorted(pool, key=lambda m: (d[m], m))[:k]
            out[i, j] = donors[near, j].mean() if near else donors[have[:, j], j].mean()
    return out


def test_filled_values_equal_brute_force_for_all_missing_patterns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(160, 4))
    x[rng.random(x.shape) < 0.25] = np.nan
    x[:3] = np.nan  # nothing to go by: column means
    cell = lambda v: None if np.isnan(v) else float(v)
    df = spark.createDataFrame([(i, *map(cell, r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got = {r["id"]: r[1:] for r in features.KnnImpute(["a", "b", "c", "d"]).fit(df).transform(df).collect()}
    want = brute_fill(x, x, 5)
    assert all(np.allclose(got[i], want[i]) for i in range(len(x)))


def test_more_donors_than_the_driver_held_before(spark):
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 1000, 7000)
    df = spark.createDataFrame([(i, float(v), None if i % 500 == 0 else float(v) * 2) for i, v in enumerate(a)], "id int, a double, b double")
    got = {r["id"]: r["b"] for r in features.KnnImpute(["a", "b"]).fit(df).transform(df).filter("id % 500 = 0").collect()}
    donors = np.array([i for i in range(len(a)) if i % 500])
    for i, b in got.items():
        near = donors[np.argsort(np.abs(a[donors] - a[i]))[:5]]
        assert abs(b - (a[near] * 2).mean()) < 1e-9


def test_retrieval_breaks_ties_by_key_on_both_paths(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0, 1.0], [3.0, 0.0]] * 3)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(i % 3 == 0)) for i, r in enumerate(x)], "id long, v array<double>, label int")
    near = vectors.retrieval_metrics(df, "id", "v", "label", 3).first()
    far = vectors.retrieval_metrics(df, "id", "v", "label", 3, broadcast_bytes=0, block_rows=4).first()
    assert np.allclose(tuple(near), tuple(far))


def test_many_categories_become_one_sparse_vector(spark):
    df = spark.range(100_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit("often")).otherwise(F.concat(F.lit("c"), F.col("id"))).alias("g"), (F.col("id") % 2).cast("string").alias("h"))
    model = features.OneHotVectors(["g", "h"], "hot").fit(df.filter("id < 90000"))
    assert len(model.categories["g"]) == 30_001
    rows = model.transform(df.filter("id >= 89995 and id < 90005")).orderBy("id").collect()
    assert rows[0]["hot"].size == 30_003 and not {"g", "h"} & set(rows[0].asDict())
    for r in rows:
        i = r["id"]
        names = [(model.categories["g"] + model.categories["h"])[p] for p in r["hot"].indices]
        g = [] if i % 3 == 0 or (i % 3 == 2 and i >= 90_000) else ["often" if i % 3 == 1 else f"c{i}"]
        assert names == [*g, str(i % 2)]


def test_label_sets_count_like_label_columns(spark):
    rng = np.random.default_rng(8)
    y, p = rng.random((50, 4)) < 0.4, rng.random((50, 4)) < 0.4
    sets = spark.createDataFrame([(i % 2, [int(j) for j in np.flatnonzero(a)], [int(j) for j in np.flatnonzero(b)]) for i, (a, b) in enumerate(zip(y, p))], "f int, y array<int>, pred array<int>")
    wide = spark.createDataFrame([(i % 2, *map(int, a), *map(int, b)) for i, (a, b) in enumerate(zip(y, p))], "f int, " + ", ".join(f"{n}{j} int" for n in "yp" for j in range(4)))
    for keys in ([], ["f"]):
        a = {tuple(r[k] for k in [*keys, "metric"]): r["value"] for r in metrics.label_set_metrics(sets, 4, keys).collect()}
        b = {tuple(r[k] for k in [*keys, "metric"]): r["value"] for r in metrics.multilabel_metrics(wide, {j: (f"y{j}", f"p{j}") for j in range(4)}, keys).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_a_block_is_sent_once_per_part_and_not_once_per_block(spark):
    """All 1,600 pairs of blocks are met, in 64 tasks' worth of parts: what meets is a block per part, not per pair."""
    x = np.random.default_rng(9).normal(size=(640, 24))
    df = frame(spark, x)
    own = neighbours.rings(neighbours.entries(df, "id", "v", 6).localCheckpoint(), 8)
    pairs = neighbours.visits(own, own, lambda row, block, n, low: np.ones(len(block), bool))
    assert pairs.agg(F.sum(F.size("visited"))).first()[0] == len(own.blocks) ** 2 and pairs.agg(F.sum("n")).first()[0] == 640**2
    assert pairs.count() == len(own.blocks) * own.parts() and own.parts() == neighbours.PARTS
    counted = neighbours.met(own, own, pairs, lambda q, shelves: neighbours.pd.DataFrame({"id": q["ids"], "n": sum(len(s["ids"]) for s in shelves)}), "id long, n long")
    assert counted.count() == 640 * neighbours.PARTS and {r["n"] for r in counted.groupBy("id").agg(F.sum("n").alias("n")).collect()} == {640}


def test_links_of_a_task_keep_what_reaches_what():
    found = neighbours._spanning(neighbours.pd.DataFrame({"a": [9, 8, 7, 30, 5], "b": [8, 7, 5, 20, 5]}))
    assert {tuple(r) for r in found.to_numpy().tolist()} == {(9, 5), (8, 5), (7, 5), (30, 20)}


def test_similarities_are_ranked_where_they_are_made(spark):
    """A gallery in parts: every query against brute force, and no similarity in a shuffle or a grouping."""
    rng = np.random.default_rng(12)
    x, label = rng.integers(-2, 3, (90, 3)).astype(float), rng.integers(0, 4, 90)
    x[:2] = 0
    label[5] = 9
    df = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label))], "id long, v array<float>, label int")
    rows = pairwise.ranking_rows(df, "id", "v", "label", 3, broadcast_bytes=0, block_rows=20)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "collect_list" not in plan and "CoGroup" not in plan
    norm = np.linalg.norm(x, axis=1)
    sims = x @ x.T / np.clip(norm[:, None] * norm[None], 1e-12, None)
    for r in rows.collect():
        others = [j for j in range(90) if j != r["id"]]
        order = sorted(others, key=lambda j: (-sims[r["id"], j], j))
        at = [p for p, j in enumerate(order) if label[j] == label[r["id"]]]
        assert (r["hits"], r["relevant"], r["others"]) == (sum(p < 3 for p in at), len(at), 89)
        assert r["ap"] == (None if not at else pytest.approx(np.mean([(i + 1) / (p + 1) for i, p in enumerate(at)])))
        assert r["rr"] == (None if not at else pytest.approx(1 / (at[0] + 1)))
