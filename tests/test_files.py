"""Sources and sinks: guards, defaults, round trips."""

import pytest
from pyspark.sql import functions as F

from assayloom.sinks.files import append_metrics, write_by_split, write_csv, write_parameters
from assayloom.sources.files import (
    DEFAULT_PARAMETERS,
    METRICS_SCHEMA,
    read_csv,
    read_parameters,
    read_records,
    read_vectors,
)
from assayloom.sources.tables import MissingInput, filtered_scan, scan, table
from assayloom.staging import fresh_path, shared_folder, stage


def test_missing_input(spark, tmp_path):
    with pytest.raises(MissingInput, match="nothing_here"):
        scan(spark, f"{tmp_path}/nothing_here.parquet")


def test_filter_and_columns_reach_the_scan(spark, small, capsys):
    filtered_scan(table(spark, small, "lineitem"), {"l_returnflag": "R"}, ["l_orderkey"]).explain()
    plan = capsys.readouterr().out
    assert "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan


def test_csv_keeps_quotes_and_breaks(spark, tmp_path):
    rows = [("a", 'say "hi", twice'), ("b", "two\nlines"), ("c", None)]
    write_csv(spark.createDataFrame(rows, "id string, t string"), f"{tmp_path}/csv")
    assert {tuple(r) for r in read_csv(spark, f"{tmp_path}/csv", "id string, t string", multi_line=True).collect()} == set(rows)


def test_parameters(spark, tmp_path):
    assert read_parameters(spark, f"{tmp_path}/absent") == DEFAULT_PARAMETERS
    write_parameters(spark, f"{tmp_path}/best", {"max_depth": 9, "gamma": 0.5})
    assert read_parameters(spark, f"{tmp_path}/best") == {**DEFAULT_PARAMETERS, "max_depth": 9, "gamma": 0.5}


def test_runs_table_appends(spark, tmp_path):
    for run, rmse in (("first", 0.9), ("second", 0.7)):
        record = spark.createDataFrame([(run, rmse, 0.1, (4,))], "run string, rmse double, r2 double, best_params struct<max_depth:int>")
        append_metrics(record, f"{tmp_path}/runs")
    found = read_records(spark, f"{tmp_path}/runs", METRICS_SCHEMA).select("run", "rmse", "best_params.max_depth").collect()
    assert {tuple(r) for r in found} == {("first", 0.9, 4), ("second", 0.7, 4)}


def test_vectors_by_split_prune(spark, tmp_path, capsys):
    frame = spark.createDataFrame([(i, [float(i)] * 3, s) for i, s in enumerate(["train", "valid", "test"])], "id int, features array<float>, split string")
    write_by_split(frame, f"{tmp_path}/v")
    valid = read_vectors(spark, f"{tmp_path}/v", "valid")
    assert [(r["id"], r["features"]) for r in valid.collect()] == [(1, [1.0] * 3)]
    valid.explain()
    assert "PartitionFilters: [isnotnull(split" in capsys.readouterr().out
    assert read_vectors(spark, f"{tmp_path}/v").count() == 3


def test_staging_uses_the_shared_folder(spark):
    assert fresh_path(spark, "x").startswith(shared_folder(spark))
    staged = stage(spark.range(5).withColumn("x", F.col("id") * 2), "numbers")
    assert staged.agg(F.sum("x")).first()[0] == 20
    assert shared_folder(spark) in staged.inputFiles()[0]


@pytest.mark.parametrize("named", [True, False])
def test_a_cluster_stages_in_a_plain_folder_that_is_shared(spark, tmp_path, monkeypatch, named):
    from assayloom import staging

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(spark.sparkContext, "getCheckpointDir", lambda: None)
    monkeypatch.setattr(spark.sparkContext, "setCheckpointDir", lambda folder: None)
    monkeypatch.setattr(staging, "_SHARED", set())
    conf = {"spark.checkpoint.dir": f"{tmp_path}/shared" if named else None, "spark.sql.warehouse.dir": f"file:{tmp_path}/warehouse"}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, name, default=None: conf.get(name, default))
    staged = stage(spark.range(5), "numbers")
    assert staged.count() == 5
    assert (f"{tmp_path}/shared/" if named else f"{tmp_path}/warehouse/_assayloom/") in staged.inputFiles()[0]
    assert len(staging._SHARED) == 1


def test_a_cluster_refuses_a_folder_of_each_machine(spark, tmp_path, monkeypatch):
    """A driver that finds none of the tasks' files."""
    from pyspark.sql import DataFrameReader

    from assayloom import staging

    reader = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, path: reader(self, path).limit(0))
    with pytest.raises(RuntimeError, match="folder of each machine"):
        staging._require_shared(spark, f"{tmp_path}/own")
    assert (spark.sparkContext.applicationId, f"{tmp_path}/own") not in staging._SHARED


def test_staged_tables_can_be_dropped(spark, tmp_path):
    from assayloom.staging import drop_staged, fresh_path, stage

    staged = stage(spark.range(5), "few")
    folder = fresh_path(spark, "x").rsplit("/", 1)[0]
    assert staged.count() == 5 and spark.read.parquet(f"{folder}/few-*").count() == 5
    drop_staged(spark)
    with pytest.raises(Exception):
        spark.read.parquet(f"{folder}/few-*").count()


def test_csv_keeps_any_text(spark, tmp_path):
    texts = ["", None, " a ", "\t", "a\nb", "a\r\nb\n", '"', '","', "\\", "\\n", "\x1b", "\x1bN", "\x1b0", "\x1be", "C\\C=C\\n1", "é,日本"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    write_csv(frame, f"{tmp_path}/c")
    read = read_csv(spark, f"{tmp_path}/c", "i INT, t STRING", malformed="FAILFAST")
    assert {r["i"]: r["t"] for r in read.collect()} == dict(enumerate(texts))
