import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import order_statistics
from assayloom.operators.order_statistics import quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.5, 0.75, 0.999, 1.0]


def columns_of(kind, rng, count=3000):
    if kind == "spread":
        return [rng.gauss(0, 1) for _ in range(count)]
    if kind == "one value fills most":
        return [0.5] * (count * 2 // 3) + [rng.random() for _ in range(count // 3)]
    if kind == "few values":
        return [float(rng.randrange(4)) for _ in range(count)]
    if kind == "two ends":
        return [-1.0] * (count // 2) + [1.0] * (count // 2) + [0.0] * 3
    if kind == "far out":
        return [rng.random() for _ in range(count)] + [1e300, -1e300]
    return [7.0] if kind == "single" else [1.0, 2.0]


@pytest.mark.parametrize("kind", ["spread", "one value fills most", "few values", "two ends", "far out", "single", "pair"])
@pytest.mark.parametrize("accuracy,held", [(10_000, 200_000), (100, 200_000), (50, 20)])
def test_quantiles_equal_numpy(spark, kind, accuracy, held, monkeypatch):
    values = columns_of(kind, random.Random(3))
    rows = [(v,) for v in values] + [(None,)] * 5
    df = spark.createDataFrame(rows, "v double").repartition(5).cache()
    n, found, (high,) = quantiles(df, "v", SHARES, [F.max("v")], accuracy=accuracy, held_rows=held)
    assert n == len(values) and high == max(values)
    assert found == pytest.approx(np.quantile(values, SHARES).tolist(), abs=1e-12)


def test_few_rows_reach_the_driver(spark, monkeypatch):
    """With room for few rows the brackets narrow, and what is grouped in the end stays within that room."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v")).cache()
    values = np.sort((np.arange(200_000) * 7919 % 200_003).astype(float))
    scans, located = [], order_statistics._located
    narrowed = order_statistics._narrowed
    monkeypatch.setattr(order_statistics, "_narrowed", lambda *a: scans.append(1) or narrowed(*a))

    def watched(frame, column, ranks, brackets):
        inside = sum(int(((values > low) & (values < high)).sum()) for low, high in set(brackets))
        assert inside <= 200 * len(ranks)
        return located(frame, column, ranks, brackets)

    monkeypatch.setattr(order_statistics, "_located", watched)
    found = quantiles(df, "v", [0.1, 0.5, 0.9], accuracy=200, held_rows=400)[1]
    assert found == pytest.approx(np.quantile(values, [0.1, 0.5, 0.9]).tolist()) and len(scans) == 1
    assert quantiles(df, "v", [0.5])[1] == pytest.approx([np.quantile(values, 0.5)]) and len(scans) == 1


def test_no_values_and_no_shares(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles(df, "v", [0.5]) == (0, [None], [])
    assert quantiles(df.limit(0), "v", [0.5, 0.1], [F.count(F.lit(1))]) == (0, [None, None], [0])
    assert quantiles(spark.range(3), "id", []) == (3, [], [])
    assert quantiles(spark.range(4), "id", [0.5]) == (4, [1.5], [])
