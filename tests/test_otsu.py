"""Thresholds whose variances are equal."""

from siftworks.operators import images


def test_the_lowest_of_equal_variances_is_taken(spark):
    levels = [0] + [31] * 5 + [32] * 5 + [63]  # mirrored, so cuts above 0 and below 63 are equally good
    rows = [(i, [0.37 * i + (0.1 + 0.013 * i) * v for v in levels]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, px array<double>")
    got = {r["id"]: r["threshold"] for r in images.otsu_thresholds(df, "id", "px").collect()}
    for i, px in rows:
        lo, hi = min(px), max(px) + 1e-6
        assert abs(got[i] - (lo + (hi - lo) * 0.5 / images.OTSU_BINS)) < 1e-9
