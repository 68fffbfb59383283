"""Metrics, curves and diagnostics on edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assayloom.operators import classification as C
from assayloom.operators import regression as R


def pairs(spark, rows):
    return spark.createDataFrame([(float(t), float(p)) for t, p in rows], "y_true double, y_pred double")


def metrics(spark, rows):
    return R.regression_metrics(pairs(spark, rows)).first()


def test_regression_edges(spark):
    perfect = metrics(spark, [(1, 1), (2, 2), (4, 4)])
    assert (perfect["rmse"], perfect["r2"], round(perfect["pearson_r2"], 12)) == (0.0, 1.0, 1.0)
    mean = metrics(spark, [(1, 2), (2, 2), (3, 2)])
    assert abs(mean["r2"]) < 1e-12 and mean["pearson_r2"] is None
    constant = metrics(spark, [(2, 2), (2, 3)])
    assert constant["r2"] == 0.0
    assert metrics(spark, [(2, 2)])["r2"] == 1.0
    biased = metrics(spark, [(1, 3), (2, 4), (3, 5)])
    assert round(biased["pearson_r2"], 12) == 1.0 and biased["r2"] < 0


def test_metrics_by_group(spark):
    frame = pairs(spark, [(1, 1), (2, 3), (5, 5)]).withColumn("g", F.col("y_true") > 4)
    assert {r["g"]: r["n"] for r in R.regression_metrics(frame, by=["g"]).collect()} == {False: 2, True: 1}


def classes(spark, cells):
    rows = [(t, p) for (t, p), n in cells.items() for _ in range(n)]
    return spark.createDataFrame(rows, "true int, predicted int")


def test_recorded_confusion(spark):
    frame = classes(spark, {(1, 1): 519, (1, 0): 78, (0, 1): 214, (0, 0): 145})
    found = C.classification_metrics(frame).first()
    assert [round(found[c], 6) for c in ("accuracy", "precision", "recall", "f1")] == [0.694561, 0.708049, 0.869347, 0.780451]
    cells = {(r["true"], r["predicted"]): r["count"] for r in C.confusion_matrix(frame).collect()}
    assert cells == {(1, 1): 519, (1, 0): 78, (0, 1): 214, (0, 0): 145}


def test_no_predicted_positives(spark):
    frame = classes(spark, {(1, 0): 2, (0, 0): 3})
    found = C.classification_metrics(frame).first()
    assert (found["precision"], found["recall"], found["f1"]) == (0.0, 0.0, 0.0)
    assert C.confusion_matrix(frame).count() == 4


def scored(spark, rows):
    return spark.createDataFrame([(t, float(s)) for t, s in rows], "true int, score double")


def test_auc_edges(spark):
    def auc(rows):
        return C.roc_auc(scored(spark, rows), "true", "score").first()["auc"]

    assert auc([(1, 0.5), (0, 0.5), (1, 0.5)]) == 0.5
    assert auc([(1, 0.9), (0, 0.1)]) == 1.0
    assert auc([(1, 0.1), (0, 0.9)]) == 0.0
    assert auc([(1, 0.1), (1, 0.9)]) is None


def brute_auc(rows):
    pos, neg = [s for t, s in rows if t], [s for t, s in rows if not t]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_and_curve(spark):
    draw = random.Random(3)
    rows = [(draw.randint(0, 1), draw.randint(0, 80) / 7) for _ in range(500)]
    frame = scored(spark, rows).repartition(4)
    expected = brute_auc(rows)
    assert abs(C.roc_auc(frame, "true", "score").first()["auc"] - expected) < 1e-12
    stretched = frame.withColumn("score", F.exp("score"))
    assert abs(C.roc_auc(stretched, "true", "score").first()["auc"] - expected) < 1e-12
    curve = C.roc_curve(frame, "true", "score")
    points = sorted((r["fpr"], r["tpr"]) for r in curve.collect())
    assert points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)
    assert all(a[1] <= b[1] for a, b in zip(points, points[1:]))
    assert abs(C.area_under(curve, "fpr", "tpr").first()["area"] - expected) < 1e-12


def test_histogram(spark):
    draw = random.Random(8)
    values = sorted(draw.gauss(0, 1) for _ in range(700)) + [2.0] * 50
    frame = spark.createDataFrame([(v,) for v in values], "residual double").repartition(4)
    ordered = sorted(values)

    def quartile(q):
        place = (len(ordered) - 1) * q
        low = int(place)
        return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (place - low)

    assert R.quartiles(frame, "residual", len(values)) == pytest.approx((quartile(0.25), quartile(0.75)))
    bins = R.histogram(frame, "residual").orderBy("bin").collect()
    assert sum(r["count"] for r in bins) == len(values)
    assert bins[0]["low"] == min(values) and bins[-1]["high"] == pytest.approx(max(values))
    for r in bins[:-1]:
        assert r["count"] == sum(r["low"] <= v < r["high"] for v in values)


def test_histogram_of_one_value(spark):
    frame = spark.createDataFrame([(4.0,), (4.0,)], "residual double")
    assert [r["count"] for r in R.histogram(frame, "residual").collect()] == [2]


def test_density_close_to_the_sum_over_rows(spark):
    draw = random.Random(9)
    values = [draw.gauss(5, 2) for _ in range(400)]
    frame = spark.createDataFrame([(v,) for v in values], "residual double")
    mean = sum(values) / len(values)
    width = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) * len(values) ** -0.2
    for r in R.density(frame, "residual", bin_width=0.5).collect():
        exact = sum(math.exp(-(((r["x"] - v) / width) ** 2) / 2) for v in values) * 0.5 / (width * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(exact, rel=1e-3)


def test_worst_predictions_and_lines(spark):
    frame = pairs(spark, [(1, 1.25), (2, 7), (3, 3)]).withColumn("id", F.monotonically_increasing_id())
    worst = R.report_lines(R.worst_predictions(frame, ["id"], 2)).collect()
    assert [r["line"] for r in worst] == [
        "True: 2.00 | Predicted: 7.00 | Residual: -5.00", "True: 1.00 | Predicted: 1.25 | Residual: -0.25"
    ]


def test_rows_that_have_no_value(spark):
    nan, inf = float("nan"), float("inf")
    frame = spark.createDataFrame(
        [(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 3.0), (nan, 1.0), (1.0, inf)], "y_true double, y_pred double"
    )
    found = R.regression_metrics(frame).first()
    assert (found["n"], found["skipped"]) == (2, 4) and round(found["pearson_r2"], 9) == 1.0
    values = R.histogram(frame.select("y_true"), "y_true", bins=2).orderBy("bin").collect()
    assert [(r["bin"], r["bins"], r["count"]) for r in values] == [(0, 2, 2), (1, 2, 2)]
    assert R.density(frame.select("y_true"), "y_true", 1.0).count() == 200
    cells = spark.createDataFrame([(1, 1), (0, 0), (None, 1), (2, 1)], "true int, predicted int")
    assert C.classification_metrics(cells).first()["unlabelled"] == 2
    assert {r["unlabelled"] for r in C.confusion_matrix(cells).collect()} == {2}
    scores = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (0, nan), (1, inf), (2, 0.0)], "true int, score double")
    assert C.roc_auc(scores, "true", "score").first()["auc"] == 1.0


def test_an_outlier_does_not_fill_the_histogram(spark):
    frame = spark.createDataFrame([(float(i % 7),) for i in range(2000)] + [(1e9,)], "v double")
    bins = R.histogram(frame, "v")
    assert bins.count() <= 8 and bins.agg(F.sum("count")).first()[0] == 2001
