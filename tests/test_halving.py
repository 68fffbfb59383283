import json

import pytest
from pyspark.sql import functions as F

from assayloom.learning import boosting, halving
from assayloom.learning.halving import LOGISTIC, SQUARED, Search, grow
from assayloom.learning.search import Real, Whole
from assayloom.plans import queries_models as Q
from assayloom.plans.training import REGRESSION, tune_by_halving
from assayloom.sources.files import read_parameters

SPACE = (Whole("n_estimators", 3, 6), Whole("max_depth", 1, 3), Real("learning_rate", 0.05, 0.5, log=True), Real("subsample", 0.6, 1.0))


@pytest.fixture(scope="module")
def rows(spark, small):
    return Q.split_vectors(spark, small).select("vec_id", "split", "vector", "y", "label").coalesce(2).cache()


@pytest.mark.parametrize("loss,make", [(SQUARED, boosting.regressor), (LOGISTIC, boosting.classifier)])
def test_rungs_equal_one_plain_fit(rows, loss, make):
    params = {"n_estimators": 5, "max_depth": 2, "learning_rate": 0.3}
    first, _ = grow(rows.withColumn("margin", F.lit(0.0)), loss, params, "vec_id", 0, 2, 42)
    grown, trees = grow(first, loss, params, "vec_id", 2, 5, 42)
    assert len(trees) == 3
    model = make(params).fit(rows.where("split = 'train'"))
    found = {r["vec_id"]: r["margin"] for r in grown.collect()}
    scored = model.transform(rows)
    for r in scored.collect():
        wanted = r["y_pred"] if loss is SQUARED else r["raw"][1]
        assert found[r["vec_id"]] == pytest.approx(wanted, abs=1e-9)
    if loss is LOGISTIC:
        valid = grown.where("split = 'valid'")
        logged = model.evaluateEachIteration(rows.where("split = 'valid'"))[-1]
        assert valid.agg(loss.score(F.col("margin"))).first()[0] == pytest.approx(logged)


def test_a_search_goes_on_where_it_was_broken_off(spark, rows, tmp_path, monkeypatch):
    def search(path):
        return Search(rows, LOGISTIC, "vec_id", f"{tmp_path}/{path}", SPACE, 5, first_rounds=1)

    wanted = search("whole").run().orderBy("rung", "trial").collect()
    counts = {rung: [r["kept"] for r in wanted if r["rung"] == rung] for rung in {r["rung"] for r in wanted}}
    assert [(len(c), sum(c)) for _, c in sorted(counts.items())] == [(5, 2), (2, 1), (1, 1)]
    for rung in (0, 1):
        found = sorted((r["score"], r["trial"]) for r in wanted if r["rung"] == rung)
        kept = {r["trial"] for r in wanted if r["rung"] == rung + 1}
        assert {t for _, t in found[: len(kept)]} == kept
    assert all(r["rounds"] == min(2 ** r["rung"], json.loads(r["params"])["n_estimators"]) for r in wanted)

    grown, calls = halving.grow, []

    def fails_at_the_seventh(*args):
        calls.append(args[4:6])
        if len(calls) == 7:
            raise RuntimeError("the driver is lost")
        return grown(*args)

    monkeypatch.setattr(halving, "grow", fails_at_the_seventh)
    broken = search("broken")
    broken.parallelism = 1
    with pytest.raises(RuntimeError):
        broken.run()
    assert broken.ledger().count() == 6
    again = search("broken")
    assert again.run().orderBy("rung", "trial").collect() == wanted
    assert len(calls) == 9
    assert search("broken").run().orderBy("rung", "trial").collect() == wanted and len(calls) == 9

    trial, params, rungs = again.winner()
    assert (trial, rungs) == ([r["trial"] for r in wanted if r["rung"] == 2][0], 3) and params["max_depth"] in (1, 2, 3)
    margins = again.with_margins(rows, trial, rungs).where("split = 'valid'").agg(LOGISTIC.score(F.col("margin"))).first()[0]
    assert margins == pytest.approx([r["score"] for r in wanted if r["rung"] == 2][0])


def test_refused_settings_and_no_ledger(rows, tmp_path):
    empty = Search(rows, SQUARED, "vec_id", f"{tmp_path}/none", SPACE, 3)
    assert empty.ledger().count() == 0
    with pytest.raises(ValueError):
        Search(rows, SQUARED, "vec_id", f"{tmp_path}/none", SPACE, 3, kept_one_in=1)


def test_the_winner_is_written(spark, rows, tmp_path):
    ledger = tune_by_halving(rows, REGRESSION, "vec_id", f"{tmp_path}/s", SPACE, 2, first_rounds=1).collect()
    won = [json.loads(r["params"]) for r in ledger if r["rung"] == 1 and r["kept"]]
    saved = read_parameters(spark, f"{tmp_path}/s/best", {})
    assert len(won) == 1 and saved == pytest.approx(won[0])
    mean = rows.where("split = 'valid'").agg(F.stddev_pop("y")).first()[0]
    assert min(r["score"] for r in ledger) < mean * 1.05
