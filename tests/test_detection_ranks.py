"""Predictions are ranked once for all thresholds."""

from siftworks.operators import detection, ordering


def test_one_running_total_serves_all_thresholds(spark, monkeypatch):
    box = "double, ".join(("x1 ", "y1 ", "x2 ", "y2 ")) + "double"
    truth = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 50.0, 0.0, 60.0, 10.0), (2, 3, 0.0, 0.0, 10.0, 10.0)], f"image_id int, truth_id int, {box}")
    pred = spark.createDataFrame(
        [(1, 7, 0.9, 0.0, 0.0, 10.0, 8.0), (1, 8, 0.8, 0.0, 0.0, 10.0, 10.0), (1, 9, 0.7, 50.0, 0.0, 60.0, 6.0), (2, 9, 0.6, 90.0, 0.0, 99.0, 9.0), (2, 9, 0.5, 0.0, 0.0, 10.0, 7.0)],
        f"image_id int, pred_id int, score double, {box}")  # an id that repeats in its image is one more prediction, not four
    ranked = []

    def spy(df, *rest):
        ranked.append(df.count())
        return ordering.running_totals(df, *rest)

    monkeypatch.setattr(detection, "running_totals", spy)
    m = detection.detection_metrics(pred.filter("pred_id < 9 or image_id = 1"), truth).first()
    assert ranked == [3]  # 30 when every threshold had its own rows
    # hits in rank order: at 0.5 to 0.6 yes, no, yes; to 0.8 yes, no, no; above no, yes, no
    low, mid, high = (1 + 2 / 3) / 3, 1 / 3, 1 / 2 / 3
    assert abs(m["map"] - (3 * low + 4 * mid + 3 * high) / 10) < 1e-12 and abs(m["map_50"] - low) < 1e-12 and abs(m["map_75"] - mid) < 1e-12
    assert abs(m["precision"] - 2 / 3) < 1e-12 and abs(m["recall"] - 2 / 3) < 1e-12
    detection.detection_metrics(pred, truth)
    assert ranked == [3, 5]
