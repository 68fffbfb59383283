"""Trees, stopping, search, encoding and scoring: invariants on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from assayloom.functions.text import fingerprint, tokens
from assayloom.functions.vectors import positive_probability
from assayloom.learning import boosting, search
from assayloom.learning.encoding import encode_texts
from assayloom.learning.features import with_fingerprint_vector
from assayloom.operators.regression import regression_metrics
from assayloom.plans import queries_models as Q
from assayloom.plans.analysis import analyse_classification_file, analyse_regression_file
from assayloom.plans.training import CLASSIFICATION, REGRESSION, embed, train_and_evaluate
from assayloom.sources.files import CLASS_METRICS_SCHEMA, read_records, read_vectors
from assayloom.sources.models import load_model
from assayloom.streaming.scoring import accepted, read_requests, rejected, run_stream, score


@pytest.fixture(scope="module")
def parts(spark, small):
    return Q.parts(spark, small)


def test_trees_beat_the_mean_on_their_training_rows(parts):
    train, _, _ = parts
    model = boosting.regressor(Q.SMALL_TREES).fit(train)
    found = regression_metrics(model.transform(train), "y", "y_pred").first()
    assert found["r2"] > 0.2


def test_predictions_keep_their_rows(spark, small, parts):
    _, _, test = parts
    expected = {r["vec_id"] for r in test.select("vec_id").collect()}
    for query in (Q.regression_predictions, Q.class_predictions):
        rows = query(spark, small).collect()
        assert {r["id"] for r in rows} == expected and len(rows) == len(expected)
    assert all(0 <= r["predicted_probability"] <= 1 and r["predicted"] in (0, 1) for r in rows)


def test_stopped_fit_is_a_prefix(parts):
    train, valid, _ = parts
    params = {**Q.SMALL_TREES, "n_estimators": 6}
    longer = boosting.regressor(params).fit(train)
    shorter = boosting.regressor(params, rounds=3).fit(train)
    assert list(longer.treeWeights[:3]) == list(shorter.treeWeights)
    fit = boosting.fit_with_stopping(boosting.regressor, params, train, valid, patience=2)
    assert len(fit.losses) == 6 and fit.rounds == boosting.best_round(fit.losses, 2)
    assert fit.model.getNumTrees == fit.rounds


@pytest.mark.parametrize("make", [boosting.regressor, boosting.classifier])
def test_first_rounds_equal_a_shorter_fit(parts, make, tmp_path):
    train, valid, _ = parts
    whole = make(Q.SMALL_TREES).fit(train)
    kept, shorter = boosting.first_rounds(whole, 3), make(Q.SMALL_TREES, rounds=3).fit(train)
    kept.write().overwrite().save(f"{tmp_path}/kept")
    outputs = [c for c in ("y_pred", "predicted", "probability") if c in kept.transform(valid).columns]
    expected = shorter.transform(valid).select("vec_id", *outputs).orderBy("vec_id").collect()
    for model in (kept, type(kept).load(f"{tmp_path}/kept")):
        assert (model.getNumTrees, model.numFeatures) == (3, whole.numFeatures)
        assert model.transform(valid).select("vec_id", *outputs).orderBy("vec_id").collect() == expected


def test_area_of_every_round(parts):
    train, valid, _ = parts
    whole = boosting.classifier({**Q.SMALL_TREES, "n_estimators": 5}).fit(train)
    found = [a for areas in boosting.areas_by_round(whole, valid, per_pass=2) for a in areas]
    for n in range(1, 6):
        scored = boosting.first_rounds(whole, n).transform(valid).select("label", positive_probability(F.col("probability")).alias("p"))
        rows = scored.collect()
        pairs = [(a["p"], b["p"]) for a in rows for b in rows if a["label"] == 1 and b["label"] == 0]
        expected = sum(1 if a > b else 0.5 if a == b else 0 for a, b in pairs) / len(pairs)
        assert found[n - 1] == pytest.approx(expected)
    one_class = boosting.areas_by_round(whole, valid.where("label = 1"))
    assert [a for areas in one_class for a in areas] == [0.5] * 5


def test_stopping_on_the_area(parts):
    train, valid, _ = parts
    params = {**Q.SMALL_TREES, "n_estimators": 6}
    fit = boosting.fit_with_stopping(boosting.classifier, params, train, valid, 2, "auc")
    assert fit.model.getNumTrees == fit.rounds == boosting.best_round(fit.losses, 2)
    assert all(0 <= loss <= 1 for loss in fit.losses)
    with pytest.raises(ValueError):
        boosting.fit_with_stopping(boosting.classifier, params, train, valid, 2, "accuracy")


def test_fingerprint_vectors_hold_the_checked_fingerprint(spark):
    frame = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha"), (3, ""), (4, None)], "id int, t string")
    found = {r["id"]: r["vector"] for r in with_fingerprint_vector(frame, "t").collect()}
    expected = {r["id"]: r["f"] for r in frame.select("id", fingerprint(tokens(F.col("t"))).alias("f")).collect()}
    assert set(found) == {1, 2}
    assert all(list(v.indices) == expected[i] and set(v.values) == {1.0} for i, v in found.items())


def test_parameters_reach_the_trees(spark):
    space = {"n_estimators": 7, "max_depth": 4, "learning_rate": 0.2, "subsample": 0.7, "colsample_bytree": 0.6, "gamma": 0.1, "min_child_weight": 3}
    trees = boosting.regressor(space)
    assert (trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize(), trees.getSubsamplingRate()) == (7, 4, 0.2, 0.7)
    assert (trees.getFeatureSubsetStrategy(), trees.getMinInfoGain(), trees.getMinInstancesPerNode()) == ("0.6", 0.1, 3)


def test_trials_are_reproducible_and_in_range(spark):
    few = search.draw_trials(spark, search.VECTOR_SPACE, 5, seed=1).repartition(3).orderBy("trial").collect()
    many = search.draw_trials(spark, search.VECTOR_SPACE, 200, seed=1).orderBy("trial").collect()
    assert few == many[:5]
    assert search.draw_trials(spark, search.VECTOR_SPACE, 5, seed=2).orderBy("trial").collect() != few
    drawn = [r["params"] for r in many]
    assert {p["n_estimators"] for p in drawn} <= set(range(500, 2001, 100))
    assert {p["max_depth"] for p in drawn} == set(range(4, 13))
    assert all(0.001 <= p["learning_rate"] <= 0.1 and 0 <= p["gamma"] <= 5 for p in drawn)
    below = sum(p["learning_rate"] < 0.01 for p in drawn)
    assert 70 < below < 130


def test_encoder(spark):
    frame = spark.createDataFrame([(1, "alpha beta"), (2, "beta alpha"), (3, "gamma"), (4, "")], "id int, t string")
    found = {r["id"]: r["features"] for r in encode_texts(frame, "t", length=16).collect()}
    assert all(len(v) == 64 and all(map(math.isfinite, v)) for v in found.values())
    assert found[1] == pytest.approx(found[2], abs=1e-6) and found[1] != found[3]
    assert found[4] == [0.0] * 64


def test_encoder_is_pluggable(spark):
    def make():
        return lambda input_ids, attention_mask: attention_mask.sum(axis=1, keepdims=True).astype("float32")

    frame = spark.createDataFrame([(1, "a b c"), (2, "a")], "id int, t string")
    found = encode_texts(frame, "t", make_encoder=make, length=8)
    assert {r["id"]: r["features"] for r in found.collect()} == {1: [3.0], 2: [1.0]}


def test_batch_equals_stream(spark, small, tmp_path):
    batch = {r["vec_id"]: r["response"] for r in Q.dual_scores(spark, small).collect()}
    stream = {r["vec_id"]: r["response"] for r in Q.dual_scores_stream(spark, small).collect()}
    assert batch == stream and len(batch) == 500
    assert sum(r["status"] == "error" for r in batch.values()) == len([i for i in batch if i % 11 == 0 or i % 7 == 0])
    one = batch[1]
    assert one["status"] == "success"
    assert one["classification"]["warning"].startswith("High" if one["classification"]["is_toxic"] else "Appears")


def test_stream_goes_on_with_new_files_only(spark, small, tmp_path):
    rows = Q.vectors(spark, small).select("vec_id", "features")
    source, progress, output = (f"{tmp_path}/{n}" for n in ("in", "progress", "out"))
    for low, high in ((0, 100), (100, 180)):
        rows.where(F.col("vec_id").between(low, high - 1)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        found = run_stream(score(stream, Q.saved_models(spark, small)), "s", progress, output)
        assert found.count() == high and found.select("vec_id").distinct().count() == high


def test_requests(spark):
    bodies = ['{"smiles":"CC"}', "{}", '{"smiles":1}', "nope", '{"smiles":""}', '{"smiles":null}', None]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    checked = read_requests(frame, "body", "smiles")
    found = {r["body"]: (r["smiles"], r["error"]) for r in checked.collect()}
    assert found['{"smiles":"CC"}'] == ("CC", None)
    assert found['{"smiles":""}'] == ("", None)
    assert found["{}"] == (None, "missing field")
    assert found['{"smiles":1}'] == (None, "wrong type")
    assert found["nope"] == (None, "not json")
    assert found['{"smiles":null}'][1] is not None
    assert found[None][1] == "not json"
    assert accepted(checked).count() == 2 and rejected(checked, "body").count() == 5


def test_training_job_writes_everything(spark, small, tmp_path):
    rows = Q.split_vectors(spark, small)
    path = str(tmp_path)
    predictions, record = train_and_evaluate(rows, CLASSIFICATION, Q.SMALL_TREES, "vec_id", path, "first", patience=3)
    assert load_model(f"{path}/model").transform(rows).count() == 500
    report = analyse_classification_file(spark, f"{path}/predictions")
    saved = read_records(spark, f"{path}/metrics", CLASS_METRICS_SCHEMA).first()
    assert saved["run"] == "first"
    assert report["area"].first()["area"] == pytest.approx(saved["ROC-AUC"])
    assert report["metrics"].first()["accuracy"] == pytest.approx(saved["accuracy"])
    assert sum(r["count"] for r in report["confusion"].collect()) == predictions.count()


def test_regression_job_and_report(spark, small, tmp_path):
    rows = Q.split_vectors(spark, small)
    predictions, record = train_and_evaluate(rows, REGRESSION, Q.SMALL_TREES, "vec_id", str(tmp_path), patience=3)
    report = analyse_regression_file(spark, f"{tmp_path}/predictions")
    assert report["metrics"].first()["rmse"] == pytest.approx(record.first()["rmse"])
    assert report["worst"].count() == 5
    assert sum(r["count"] for r in report["histogram"].collect()) == predictions.count()


def test_embed_writes_one_folder_per_split(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a b", "train"), (2, "c", "test")], "id int, t string, split string")
    embed(frame, "t", f"{tmp_path}/v")
    assert [r["id"] for r in read_vectors(spark, f"{tmp_path}/v", "test").collect()] == [2]


def test_request_stream_equals_batch(spark, tmp_path):
    bodies = [(f'{{"smiles":"C{i}"}}',) for i in range(20)] + [("{}",), ("nope",), ('{"smiles":1}',)]
    frame = spark.createDataFrame(bodies, "body string")
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    for part in (accepted, lambda checked: rejected(checked, "body")):
        batch = part(read_requests(frame, "body", "smiles")).collect()
        streamed = run_stream(part(read_requests(stream, "body", "smiles")), "requests").collect()
        assert sorted(map(str, streamed)) == sorted(map(str, batch)) and batch


@pytest.mark.parametrize("task", [REGRESSION, CLASSIFICATION])
def test_same_seed_same_predictions_for_any_layout(spark, small, task):
    rows = Q.split_vectors(spark, small)
    found = []
    for layout in (rows.repartition(7), rows.orderBy(F.desc("vec_id")).coalesce(2)):
        predictions, _ = train_and_evaluate(layout, task, Q.SMALL_TREES, "vec_id", patience=3, partitions=4)
        found.append(sorted(map(tuple, predictions.collect())))
    assert found[0] == found[1]
