"""The paths taken by large or skewed data, forced on small data and checked against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftworks.operators import detection, detectors, features, metrics, neighbours, ordering, pairwise, quantiles, rules, text_eval, vectors


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.just(7.0), st.floats(-1e6, 1e6, allow_nan=False)), min_size=5, max_size=400))
def test_bracketed_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = quantiles.exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9], in_memory_rows=3)["x"]
    assert np.allclose(got, np.quantile(values, [0.1, 0.25, 0.5, 0.9]), rtol=1e-12, atol=1e-9)


def test_quantiles_with_a_value_that_holds_most_rows(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 < 2, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("x"))
    want = np.quantile(df.toPandas()["x"], [0.01, 0.25, 0.5, 0.7, 0.99])
    got = quantiles.exact_quantiles(df, ["x"], [0.01, 0.25, 0.5, 0.7, 0.99], in_memory_rows=50)["x"]
    assert np.allclose(got, want)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds two thirds of the rows."""
    g = F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 17).cast("string")))
    return spark.range(3000).select("id", g.alias("g"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v")).persist()


def test_running_totals_cross_slices(skewed):
    out = ordering.running_totals(skewed, [F.col("v"), F.col("id")], {"s": F.col("v"), "n": F.lit(1)}, ["g"])
    w = Window.partitionBy("g").orderBy("v", "id")
    want = skewed.withColumn("s2", F.sum("v").over(w)).withColumn("n2", F.row_number().over(w))
    both = out.join(want.select("id", "s2", "n2"), "id")
    assert both.count() == 3000
    assert both.filter((F.col("s") != F.col("s2")) | (F.col("n") != F.col("n2"))).count() == 0


def test_lags_across_blocks(skewed):
    out = ordering.lags(skewed, "v", [F.col("id")], 3, ["g"], block_rows=50)
    w = Window.partitionBy("g").orderBy("id")
    want = skewed.select("id", *[F.lag("v", k).over(w).alias(f"w{k}") for k in (1, 2, 3)])
    both = out.join(want, "id")
    bad = ~(F.col("v_lag_1").eqNullSafe(F.col("w1")) & F.col("v_lag_3").eqNullSafe(F.col("w3")))
    assert both.count() == 3000 and both.filter(bad).count() == 0


def test_keep_first_in_hot_group(skewed):
    out = features.keep_first(skewed, ["g"], "id")
    first = {r["g"]: r["id"] for r in skewed.groupBy("g").agg(F.min("id").alias("id")).collect()}
    assert {r["g"]: r["id"] for r in out.collect()} == first


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.2, (60, 3)), rng.normal(3, 0.2, (50, 3)), rng.uniform(-6, 9, (10, 3))])
    rows = [(int(i), [float(v) for v in r], int(i < 60)) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, v array<double>, label int").persist()


FAR = {"broadcast_bytes": 0, "block_rows": 17}
SMALL = {"block_rows": 7}


def test_nearest_blocks_equal_brute_force(points):
    x, df = points
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(dist, np.inf)
    want = {i: set(np.argsort(dist[i])[:4]) for i in range(len(x))}
    for limits in ({}, SMALL):
        got: dict = {}
        for r in neighbours.nearest(df, "id", "v", 4, **limits).collect():
            got.setdefault(r["id"], set()).add(r["neighbour"])
        assert got == want


def test_retrieval_and_silhouette_blocks_agree(points):
    _, df = points
    for fn in (lambda **k: vectors.retrieval_metrics(df, "id", "v", "label", 5, **k).first(), lambda **k: vectors.silhouette(df, "id", "v", "label", **k).first()[1:]):
        assert np.allclose(tuple(fn()), tuple(fn(**FAR)))


def test_distance_sums_hold_a_strip_of_the_gallery(spark, monkeypatch):
    rng, seen, real = np.random.default_rng(4), [], pairwise.distances
    x, c = rng.normal(size=(9000, 2)), rng.integers(0, 3, 9000)
    monkeypatch.setattr(pairwise, "distances", lambda q, g: seen.append(len(g)) or real(q, g))
    side = {"key": np.arange(9000), "x": x, "c": c}

    def local(df, key, vec, payload, kernel, schema, **limits):
        return spark.createDataFrame(kernel({n: v[:5] for n, v in side.items()}, side))

    monkeypatch.setattr(pairwise, "scan", local)
    df = spark.createDataFrame([(0, [0.0, 0.0], 0)], "id long, v array<double>, c long")
    got = {(r["id"], r["cluster"]): (r["total"], r["n"]) for r in pairwise.cluster_distance_sums(df, "id", "v", "c").collect()}
    want = {(i, j): (np.sqrt(((x[c == j] - x[i]) ** 2).sum(1)).sum(), (c == j).sum()) for i in range(5) for j in range(3)}
    assert got.keys() == want.keys() and np.allclose([got[p] for p in want], list(want.values()))
    assert max(seen) <= pairwise.STRIP_ROWS


def test_dbscan_equals_brute_force(points):
    x, df = points
    eps, least = 0.5, 4
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                j = stack.pop()
                if core[j] and label[j] < 0:
                    label[j] = i
                    stack += list(np.flatnonzero(near[j] & core & (label < 0)))
    for i in np.flatnonzero(~core):
        hits = label[near[i] & core]
        label[i] = hits.min() if len(hits) else -1
    for limits in ({}, SMALL):
        got = {r["id"]: r["cluster"] for r in detectors.dbscan(df, "id", "v", eps, least, **limits).collect()}
        assert got == {i: int(c) for i, c in enumerate(label)}


def test_outlier_factor_and_forest_rank_outliers_first(points):
    x, df = points
    lof = detectors.local_outlier_factor(df, "id", "v", 8).toPandas().sort_values("score")["id"].tolist()
    forest = detectors.isolation_forest(df, "id", "v", trees=60).toPandas().sort_values("score")["id"].tolist()
    assert len(set(lof[-10:]) & set(range(110, 120))) >= 8
    assert len(set(forest[-10:]) & set(range(110, 120))) >= 8


def brute_greedy(pred, truth, threshold):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    used, out = set(), set()
    for image, pid, _, box in sorted(pred, key=lambda p: (-p[2], p[0], p[1])):
        best, at = 0.0, None
        for image2, tid, tbox in sorted(truth, key=lambda t: t[1]):
            if image2 == image and (image, tid) not in used and iou(box, tbox) > best:
                best, at = iou(box, tbox), tid
        if at is not None and best >= threshold:
            used.add((image, at))
            out.add((image, pid, at))
    return out


def test_greedy_matching_equals_serial_matching(spark):
    rng = np.random.default_rng(3)
    def box():
        x, y = rng.uniform(0, 150, 2)
        w, h = rng.uniform(20, 60, 2)
        return [float(v) for v in (x, y, x + w, y + h)]

    truth = [(i, t, box()) for i in range(3) for t in range(25)]
    pred = []
    for i, t, b in truth:
        for k in range(3):
            moved = [v + float(d) for v, d in zip(b, rng.uniform(-8, 8, 4))]
            pred.append((i, t * 10 + k, float(np.round(rng.uniform(), 1)), moved))
    cols = "x1 double, y1 double, x2 double, y2 double"
    p = spark.createDataFrame([(a, b, c, *d) for a, b, c, d in pred], "image_id int, pred_id int, score double, " + cols)
    t = spark.createDataFrame([(a, b, *c) for a, b, c in truth], "image_id int, truth_id int, " + cols)
    got = {(r["image_id"], r["pred_id"], r["truth_id"]) for r in detection.greedy_matches(detection.overlaps(p, t, 32.0), (0.5,)).collect()}
    assert got == brute_greedy(pred, truth, 0.5)
    pairs = detection.overlaps(p, t, 32.0)
    want = {(level, *m) for level in detection.THRESHOLDS for m in brute_greedy(pred, truth, level)}
    assert len({w[0] for w in want}) > 5
    for crowded in (1_000_000, len(pred) // 3, 0):  # all images in one fold, some, none
        assert {tuple(r) for r in detection.greedy_matches(pairs, crowded_pairs=crowded).collect()} == want
    assert detection.greedy_matches(pairs.filter("iou > 2")).count() == 0
    m = detection.detection_metrics(p, t, (0.5, 0.75)).first()
    assert abs(m["recall"] - len(got) / len(truth)) < 1e-12 and 0 < m["map_75"] <= m["map_50"] <= 1


def test_lexicon_in_chunks_equals_substring_search(spark):
    docs = [(i, f"alpha{i % 7} beta gamma{i} Delta") for i in range(40)]
    lex = [(f"gamma{i}", "L") for i in range(0, 50, 3)] + [("beta g", "M"), ("alpha", "N"), ("", "L")]
    got = text_eval.lexicon_matches(spark.createDataFrame(docs, "id int, t string"), "id", "t", spark.createDataFrame(lex, "surface string, label string"), chunk_rows=4)
    want = {(i, s, lab) for i, t in docs for s, lab in lex if s and s in t.lower()}
    assert {tuple(r) for r in got.collect()} == want


def test_rules_with_one_huge_basket(spark):
    rows = [("big", f"i{k}") for k in range(500)] + [(f"t{j}", x) for j in range(40) for x in ("a", "b", f"i{j}")]
    mined, summary = rules.mine_rules(spark.createDataFrame(rows, "txn string, item string"))
    assert {(r["lhs"], r["rhs"], r["n_pair"]) for r in mined.collect()} == {("a", "b", 40), ("b", "a", 40)}
    assert summary.first()["number_of_rules"] == 2


def test_auc_with_ties_equals_pair_count(spark):
    rng = np.random.default_rng(1)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 12, 300)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    pos, neg = s[y == 1][:, None], s[y == 0][None]
    want = ((pos > neg) + 0.5 * (pos == neg)).mean()
    assert abs(metrics.roc_auc(df).first()["value"] - want) < 1e-12
