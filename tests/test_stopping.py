"""Early stopping against the literal loop, many runs at once, both ways of following a run."""

import random

import pytest

from assayloom.learning.boosting import best_round
from assayloom.operators.stopping import best_epochs, best_trial, early_stops


def loop(values, patience, gap, larger=True):
    best, best_epoch, waited, stop = None, None, 0, None
    for epoch, value in enumerate(values, start=1):
        signed = value if larger else -value
        if value == value and (best is None or signed > best + gap):
            best, best_epoch, waited = signed, epoch, 0
        else:
            waited += 1
            if waited >= patience:
                stop = epoch
                break
    return (len(values), best_epoch, None if best is None else (best if larger else -best), stop)


def logs(spark, runs):
    rows = [(name, i, float(v)) for name, values in runs.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run string, epoch int, metric double").repartition(4)


RUNS = {
    "edge": [1, 2, 1.5, 2.00005, 3, 1, 1, 1],
    "rising": [i / 3000 for i in range(60)],
    "falling": [-i for i in range(12)],
    "late start": [float("nan")] * 4 + [1, 2],
    "short": [1.0],
    "recovers late": [1, 0, 0, 0, 5, 6],
    None: [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5],
}


@pytest.mark.parametrize("limit", [2, 10_000])
@pytest.mark.parametrize("patience,gap,larger", [(3, 1e-4, True), (10, 1e-3, True), (3, 0.0, True), (2, 0.0, False)])
def test_early_stops(spark, limit, patience, gap, larger):
    draw = random.Random(patience)
    runs = {**RUNS, **{f"r{i}": [round(draw.random(), 3) for _ in range(draw.randint(1, 80))] for i in range(20)}}
    result = early_stops(
        logs(spark, runs), "run", ["epoch"], "metric", patience, gap, larger, held_records=limit
    )
    found = {r["run"]: (r["epochs"], r["best_epoch"], r["best_value"], r["stop_epoch"]) for r in result.collect()}
    assert found == {name: loop(values, patience, gap, larger) for name, values in runs.items()}


def test_recorded_edge(spark):
    row = early_stops(logs(spark, {"edge": RUNS["edge"]}), "run", ["epoch"], "metric", 3, 1e-4).first()
    assert (row["best_value"], row["best_epoch"], row["stop_epoch"]) == (3.0, 5, 8)


def test_epoch_limit(spark):
    row = early_stops(logs(spark, {"r": range(30)}), "run", ["epoch"], "metric", 3, most_epochs=7).first()
    assert (row["epochs"], row["best_epoch"], row["best_value"], row["stop_epoch"]) == (7, 7, 6.0, None)


def test_best_epoch_and_trial(spark):
    found = best_epochs(logs(spark, {"a": [3, 1, 1, 2], "b": [float("nan"), 5]}), "run", "epoch", "metric").collect()
    assert {r["run"]: (r["best_epoch"], r["best_metric"]) for r in found} == {"a": (1, 1.0), "b": (1, 5.0)}
    ledger = spark.createDataFrame([(0, 0.5), (2, 0.9), (1, 0.9), (3, float("nan"))], "trial int, score double")
    assert best_trial(ledger, larger_is_better=True).first()["trial"] == 1
    assert best_trial(ledger).first()["trial"] == 0


def test_best_round():
    assert best_round([3, 2, 1, 2, 2, 0], patience=2) == 3
    assert best_round([3, 2, 1, 2, 2, 0], patience=5) == 6
    assert best_round([1.0], patience=1) == 1
