import math

import numpy as np
import pytest

from assayloom.llm import quality
from assayloom.llm.labelled import fold, training_rows
from assayloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_pairs_in_linear_time_equal_all_pairs():
    rng = np.random.default_rng(3)
    size = quality.BUCKETS + len(quality.STRUCTURE)
    model = quality.FactorisationMachine(
        0.3, rng.normal(size=size), rng.normal(size=(size, 4)), np.zeros(len(quality.STRUCTURE)), np.ones(len(quality.STRUCTURE))
    )
    rows = quality.joined([quality.features(t) for t in ("a b c a", "", "!! x 12")], model.centre, model.scale)
    margins, _ = model.sums(rows)
    for i, margin in enumerate(margins):
        part = slice(rows.starts[i], rows.starts[i + 1])
        places, values = rows.places[part], rows.values[part]
        wanted = model.bias + float(model.weights[places] @ values)
        for a in range(len(places)):
            for b in range(a + 1, len(places)):
                wanted += float(model.factors[places[a]] @ model.factors[places[b]]) * values[a] * values[b]
        assert margin == pytest.approx(wanted, rel=1e-4, abs=1e-5)


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op7_quality"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97
    bad = [b for a, b in judged if a == 0]
    assert bad.count(0) / len(bad) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_are_not_used(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = quality.fit_quality(docs, labels), quality.fit_quality(docs, other)
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (3, 0, 1), (None, 1, 1), (4, 7, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(odd, labels)
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["score"]) for r in rows)
    assert len({r["score"] for r in rows if r["row"]["doc_id"] in (3, 4)}) == 1
    assert len({r["score"] for r in rows if r["row"]["doc_id"] == 2}) == 1
    assert quality.score_quality(none, model).count() == 0
    empty = quality.fit_quality(odd, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(odd, empty).collect()} == {0.5}


def test_training_rows_are_bounded_and_outside_the_fold(spark):
    from pyspark.sql import functions as F

    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    rows = training_rows(docs, labels, "quality", 5, 0, 100)
    assert rows.count() == 100 and rows.where(fold(F.col("key"), 5) == 0).count() == 0


def test_training_rows_are_one_per_id_and_bounded_in_bytes(spark):
    docs = spark.range(20_000).selectExpr("id % 50 AS doc_id", "concat('text ', id % 3) AS text")
    labels = spark.range(50).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows = training_rows(docs, labels, "quality", 5, 0, 100).collect()
    again = training_rows(docs.repartition(7), labels, "quality", 5, 0, 100).collect()
    assert len(rows) == len({r["key"] for r in rows}) <= 50 and sorted(rows) == sorted(again)
    few = training_rows(docs, labels, "quality", 5, 0, 100, most_bytes=30).collect()
    assert len(few) == 5 and set(few) < set(rows)
