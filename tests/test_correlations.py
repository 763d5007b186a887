"""Correlations summed block by block against pandas and against one expression per pair."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftworks.operators import tabular_profile as tp
from siftworks.operators.correlations import pairwise_correlations


def found(df, cols, **limits):
    rows = pairwise_correlations(df, cols, **limits).collect()
    assert len(rows) == len({(r["col_a"], r["col_b"]) for r in rows})
    return {(r["col_a"], r["col_b"]): (r["n"], r["r"]) for r in rows}


@pytest.fixture(scope="module")
def wide(spark):
    """Sixty columns far from zero with gaps that differ by column, as pandas and as Spark."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 6))
    x = 1e6 + np.hstack([base + rng.normal(scale=0.1 * (k % 5), size=base.shape) for k in range(10)])
    x[rng.random(x.shape) < 0.2] = np.nan
    names = [f"c{i}" if i else "i" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=names)
    return pdf, spark.createDataFrame([tuple(None if np.isnan(v) and j % 2 else float(v) for j, v in enumerate(r)) for r in x], ", ".join(f"`{c}` double" for c in names)).repartition(5)


@pytest.mark.parametrize("limits", [{}, {"block_columns": 7}, {"block_columns": 7, "scan_bytes": 20_000}])
def test_many_columns_equal_pandas(wide, limits):
    pdf, df = wide
    got, want = found(df, df.columns, **limits), pdf.corr().to_numpy()
    held = pdf.notna().to_numpy().astype(int)
    both = held.T @ held
    assert len(got) == 60 * 59 // 2
    for i, a in enumerate(pdf.columns):
        for j, b in enumerate(pdf.columns[i + 1:], i + 1):
            assert got[a, b][0] == both[i, j] and got[a, b][1] == pytest.approx(want[i, j], abs=1e-9)


def test_three_hundred_columns_in_one_scan(spark):
    df = spark.range(500).select("id", *[(F.pmod(F.xxhash64("id", F.lit(i % 290)), F.lit(1000)) / 10).alias(f"v{i}") for i in range(300)])
    cols = [f"v{i}" for i in range(300)]
    pairs = pairwise_correlations(df, cols, centres=[50.0] * 300)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 500") == 1
    strong = {(r["col_a"], r["col_b"]) for r in pairs.filter("r > 0.85").collect()}
    assert strong == {(f"v{i}", f"v{i + 290}") for i in range(10)}
    assert strong == {(r["col_a"], r["col_b"]) for r in tp.correlated_pairs(df, cols).collect()}


def test_few_and_many_columns_take_the_same_decision(wide):
    _, df = wide
    cols = df.columns[:12]
    one, other = ({(r["col_a"], r["col_b"]): r["r"] for r in tp.correlated_pairs(df, cols, few_columns=n).collect()} for n in (16, 2))
    assert one.keys() == other.keys() and len(one) > 3 and all(one[k] == pytest.approx(other[k], abs=1e-9) for k in one)
    assert tp.correlated_pairs(df.limit(5), cols, few_columns=2).count() == 0


def test_odd_columns(spark):
    inf = float("inf")
    rows = [(1.0, 5.0, None, 1.0, 2, 1e9 + 1), (2.0, 5.0, None, inf, 4, 1e9 + 2), (3.0, 5.0, None, 3.0, 6, 1e9 + 3), (None, 5.0, 1.0, 4.0, 9, 1e9 + 5)]
    df = spark.createDataFrame(rows, "a double, same double, once double, wild double, whole int, far double")
    got = found(df, df.columns)
    assert got["a", "whole"] == (3, pytest.approx(1.0)) and got["a", "far"] == (3, pytest.approx(1.0))
    for pair in (("a", "same"), ("a", "once"), ("once", "wild"), ("a", "wild"), ("same", "once")):
        assert np.isnan(got[pair][1])
    assert got["a", "once"][0] == 0 and got["wild", "whole"][0] == 4
    assert found(df.filter("a > 10"), ["a", "far"]) in ({}, {("a", "far"): (0, pytest.approx(float("nan"), nan_ok=True))})
    assert found(df, ["a"]) == {}


def test_profile_of_many_columns_lists_the_pairs_in_order(spark):
    df = spark.range(300).select(*[(F.col("id") * (i + 1) if i % 9 == 0 else F.pmod(F.xxhash64("id", F.lit(i)), F.lit(97))).cast("double").alias(f"v{i}") for i in range(20)])
    assert tp.profile_table(df).correlated == [("v0", "v9"), ("v0", "v18"), ("v9", "v18")]
