"""Coercion, canonical keys, medians and log targets on hand-made edge rows."""

import statistics

import pytest
from pyspark.sql import functions as F

from assayloom.functions.numeric import negative_log_molar, threshold_label, to_number
from assayloom.functions.text import canonical_key
from assayloom.operators.collapse import collapse_duplicates
from assayloom.plans.curation import clean_measurements, curate_and_split, fetch, process_and_split
from assayloom.sources.files import SPLIT_SCHEMA, read_csv


def test_coercion(spark):
    cases = {
        "1.5": 1.5, " 1.5 ": 1.5, "1e3": 1000.0, "-2": -2.0, ".5": 0.5, "7.": 7.0, ">10": None, "1,000": None,
        "1d": None, "1f": None, "NaN": None, "inf": None, "": None, "1e999": None,
    }
    frame = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    found = {r["t"]: r["n"] for r in frame.withColumn("n", to_number(F.col("t"))).collect()}
    assert found == {**cases, None: None}


def test_canonical_key(spark):
    frame = spark.createDataFrame([("A  b",), (" a B ",), ("a\n\tb",), ("",), ("   ",), (None,)], "t string")
    assert [r[0] for r in frame.select(canonical_key(F.col("t"))).collect()] == ["a b", "a b", "a b", None, None, None]


def test_log_target_and_label(spark):
    frame = spark.createDataFrame([(1.0,), (1000.0,), (10000.0,), (0.0,), (-1.0,)], "v double")
    y = frame.select(negative_log_molar(F.col("v")).alias("y")).withColumn("label", threshold_label(F.col("y")))
    assert [(r["y"], r["label"]) for r in y.collect()] == [(9.0, 1), (6.0, 1), (5.0, 1), (19.0, 1), (None, None)]
    edge = spark.createDataFrame([(5.0,), (4.999999,)], "y double")
    assert [r[0] for r in edge.select(threshold_label(F.col("y"))).collect()] == [1, 0]


def test_collapse(spark):
    rows = [("one", 3.0, 0), ("even", 1.0, 1), ("even", 2.0, 2), ("even", 4.0, 3), ("even", 10.0, 4),
            ("gap", 1.0, 5), ("gap", None, 6), ("gap", 3.0, 7), ("none", None, 9), ("none", None, 8),
            (None, 7.0, 10), (None, 8.0, 11)]
    rows += [("hot", float((i * 37) % 101), 100 + i) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, v double, id int").repartition(5)
    result = collapse_duplicates(frame, ["k"], "v", ["id"], ["id"]).collect()
    found = {r["k"]: (r["n"], r["median_v"], r["first_id"]) for r in result}
    hot = statistics.median(r[1] for r in rows if r[0] == "hot")
    assert found == {
        "one": (1, 3.0, 0), "even": (4, 3.0, 1), "gap": (3, 2.0, 5), "none": (2, None, 8), "hot": (200, hot, 100),
        None: (2, 7.5, 10),
    }


def test_clean_measurements_drops_nan(spark):
    frame = spark.createDataFrame([("a", "1"), ("a", "NaN"), ("a", "x"), (None, "2"), ("b", None)], "k string, v string")
    assert [tuple(r) for r in clean_measurements(frame, "k", "v").collect()] == [("a", 1.0)]


def test_whole_job(spark):
    raw = [("A b", "10", "m1", "s1"), ("a  B", "30", "m0", "s1"), ("c", ">5", "m2", "s2"), (None, "1", "m3", "s2")]
    raw += [(f"x{i}", str(i + 1), f"n{i:02}", f"s{i % 4 + 3}") for i in range(40)]
    frame = spark.createDataFrame(raw, "text string, value string, id string, scaffold string")
    rows = curate_and_split(frame, "text", "value", "id", "scaffold", ["id"]).collect()
    assert len(rows) == 41
    merged = next(r for r in rows if r["canonical"] == "a b")
    assert (merged["median_value"], merged["first_id"], merged["y"]) == (20.0, "m0", 7.69897)
    splits = {}
    for r in rows:
        splits.setdefault(r["first_scaffold"], set()).add(r["split"])
    assert all(len(s) == 1 for s in splits.values())


def test_fetch_then_split_files(spark, tmp_path):
    rows = [(f"m{i:02}", f"C{i % 30}", str(10.0 * (i % 30 + 1)), "nM", "t1", "=") for i in range(60)]
    rows += [("x1", None, "5", "nM", "t1", "="), ("x2", "CC", ">5", "nM", "t1", "="), ("x3", "CN", "5", "nM", "t2", "="),
             ("x4", "CO", "5", "nM", "t1", ">")]
    names = "molecule_chembl_id canonical_smiles standard_value standard_units target relation".split()
    source = spark.createDataFrame(rows, " string, ".join(names) + " string")
    fetch(source, {"target": "t1", "relation": "="}, f"{tmp_path}/raw")
    scaffolds = spark.createDataFrame([(f"c{i}", f"s{i % 7}") for i in range(28)], "canonical_smiles string, scaffold string")
    sizes = process_and_split(spark, f"{tmp_path}/raw", f"{tmp_path}/processed", scaffolds, "scaffold")
    assert {r["split"]: r["rows"] for r in sizes.collect()} == {"train": 24, "valid": 2, "test": 4}
    read = read_csv(spark, f"{tmp_path}/processed", SPLIT_SCHEMA).collect()
    assert len(read) == 30
    first = next(r for r in read if r["smiles"] == "c0")
    assert (first["id"], first["pIC50"]) == ("m00", 8.0)
    groups = {}
    for r in read:
        number = int(r["smiles"][1:])
        groups.setdefault(f"s{number % 7}" if number < 28 else r["smiles"], set()).add(r["split"])
    assert all(len(splits) == 1 for splits in groups.values())
