"""Curation in batches, vectors encoded once, the two stream sinks, scans that skip files."""

import random

import pytest
from pyspark.sql import functions as F

from assayloom.learning.encoding import encode_texts, hashed_direction_encoder
from assayloom.learning.vector_store import add_unknown, encode_once, stored_vectors
from assayloom.operators.collapse import collapse_duplicates
from assayloom.operators.split import SPLITS
from assayloom.plans import updates
from assayloom.plans.updates import Curated
from assayloom.sources.skipping import build_index, files_to_read, skipping_scan, write_by_neighbourhood
from assayloom.sources.tables import filtered_scan
from assayloom.streaming import sinks
from assayloom.streaming.sinks import REJECTS, RESPONSES, done_batches, read_sink, run_into_sinks


def measured(rng, count, start):
    return [(f"k{rng.randrange(60)}", float(rng.randrange(1, 30)), start + i, f"g{i % 2}") for i in range(count)]


def kept(spark, path):
    return Curated(spark, path, "k", "v", ["id"], ["id"], "k", buckets=8)


def test_batches_give_the_rows_of_one_run(spark, tmp_path, monkeypatch):
    rng, schema = random.Random(5), "k string, v double, id long, g string"
    batches = [measured(rng, n, 1000 - 300 * i) for i, n in enumerate((150, 3, 90))]
    frames = [spark.createDataFrame(b, schema) for b in batches]
    table = kept(spark, f"{tmp_path}/t")
    assert table.rows() is None and table.groups() is None
    sides, versions = {}, {}
    for number, frame in enumerate(frames):
        collapse = updates.collapse_counts
        if number == 1:
            # The job breaks off after the new buckets are written: nothing is seen of them.
            before = sorted(table.rows().collect())

            def lost(*args):
                raise RuntimeError("lost")

            monkeypatch.setattr(updates, "collapse_counts", lost)
            with pytest.raises(RuntimeError):
                table.add(frame, number)
            monkeypatch.setattr(updates, "collapse_counts", collapse)
            assert sorted(table.rows().collect()) == before
        old = table.versions()
        assert table.add(frame, number) and not table.add(frame, number)
        new = table.versions()
        assert all(new[b] == old[b] for b in old if b not in {x for x in new if new[x] != old.get(x)})
        if number == 1:
            assert 0 < sum(new[b] != old.get(b) for b in new) <= 3
        rows = table.split_rows().collect()
        found = {r["k"]: r["split"] for r in rows}
        assert len(found) == len(rows) and all(found[k] == side for k, side in sides.items())
        sides, versions = found, new
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    wanted = collapse_duplicates(whole, ["k"], "v", ["id"], ["id"]).collect()
    assert sorted(tuple(r)[:4] for r in table.rows().collect()) == sorted(map(tuple, wanted))
    counts = [list(sides.values()).count(s) for s in SPLITS]
    assert counts[0] <= 0.8 * len(sides) and sum(counts) == len(wanted) == len(sides) and versions
    assert table.add(frames[0].limit(0), 7) and not table.add(frames[0], 7)
    assert table.rows().count() == len(wanted)


def test_groups_of_several_keys_stay_together(spark, tmp_path):
    rows = [(f"k{i}", float(i), i, f"g{i % 5}") for i in range(1, 60)]
    table = Curated(spark, f"{tmp_path}/t", "k", "v", ["id", "g"], ["id"], "g", buckets=4)
    for number in range(3):
        part = [r for r in rows if r[2] % 3 == number]
        table.add(spark.createDataFrame(part, "k string, v double, id long, g string"), number)
    found = table.split_rows().groupBy("first_g").agg(F.count_distinct("split").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    assert {r["n"] for r in found} == {1} and sum(r["rows"] for r in found) == 59


def never():
    raise AssertionError("nothing has to be encoded")


def test_a_text_is_encoded_once(spark, tmp_path):
    rows = [(1, "alpha beta"), (2, "alpha beta"), (3, ""), (4, None), (5, "gamma " * 900), (6, " ")]
    first = spark.createDataFrame(rows[:3], "id int, text string")
    both = spark.createDataFrame(rows, "id int, text string")
    path, encoder = f"{tmp_path}/store", hashed_direction_encoder()
    assert stored_vectors(spark, path, "v1").count() == 0
    assert add_unknown(first, "text", path, "v1", encoder) == 2
    assert add_unknown(both, "text", path, "v1", encoder) == 2
    found = encode_once(both, "text", path, "v1", never, hot_rows=1)
    assert found.columns == ["id", "text", "features"]
    plain = encode_texts(both, "text", encoder).collect()
    assert sorted(found.collect(), key=lambda r: r["id"]) == sorted(plain, key=lambda r: r["id"])
    # A second writer may have encoded the same text; another version starts anew.
    stored_vectors(spark, path, "v1").write.parquet(f"{path}/v1/run=twin")
    assert encode_once(both, "text", path, "v1", never).count() == len(rows)
    assert add_unknown(both, "text", path, "v2", encoder) == 4
    with pytest.raises(ValueError):
        stored_vectors(spark, path, "../v1")


@pytest.mark.parametrize("breaks_at", ["first sink", "second sink", "mark"])
def test_a_batch_that_is_repeated_is_there_once(spark, tmp_path, monkeypatch, breaks_at):
    source = f"{tmp_path}/in"
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "bad").alias("error"))
    rows.repartition(4, "id").write.parquet(source)
    stream = spark.readStream.schema("id long, error string").option("maxFilesPerTrigger", 1).parquet(source)
    path, checkpoint, staged = f"{tmp_path}/out", f"{tmp_path}/progress", sinks.stage
    where = {"first sink": RESPONSES, "second sink": REJECTS, "mark": "done"}[breaks_at]

    broken = []
    written = sinks.write_batch

    def write_batch(scored, number, out):
        if number == 2 and not broken:
            broken.append(number)
            held = staged(scored, "scored-batch")
            if where != RESPONSES:
                held.where("error IS NULL").write.mode("overwrite").parquet(f"{out}/{RESPONSES}/batch={number}")
            if where == "done":
                held.where("error IS NOT NULL").write.mode("overwrite").parquet(f"{out}/{REJECTS}/batch={number}")
            raise RuntimeError("the driver is lost")
        written(scored, number, out)

    monkeypatch.setattr(sinks, "write_batch", write_batch)
    with pytest.raises(Exception, match="the driver is lost"):
        run_into_sinks(stream, lambda batch: batch, path, checkpoint)
    seen = [{r["id"] for r in read_sink(spark, path, n).collect()} for n in (RESPONSES, REJECTS)]
    assert done_batches(spark, path).count() == 2 and 0 < len(seen[0]) + len(seen[1]) < 300
    run_into_sinks(stream, lambda batch: batch, path, checkpoint)
    good, bad = (sorted(r["id"] for r in read_sink(spark, path, n).collect()) for n in (RESPONSES, REJECTS))
    assert good == [i for i in range(300) if i % 3] and bad == [i for i in range(300) if i % 3 == 0]
    totals = done_batches(spark, path).agg(F.sum(RESPONSES), F.sum(REJECTS), F.count("number")).first()
    assert tuple(totals) == (200, 100, 4)


def test_sinks_before_anything_is_written(spark, tmp_path):
    assert done_batches(spark, f"{tmp_path}/none").count() == 0
    assert read_sink(spark, f"{tmp_path}/none", RESPONSES, "id long").columns == ["id", "batch"]


def test_files_are_skipped_and_no_row_is_lost(spark, tmp_path):
    rows = spark.range(20_000).select(
        "id",
        (F.col("id") * 7919 % 500).cast("int").alias("a"),
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 31 % 401).alias("b"),
        F.concat(F.lit("s"), F.col("id") * 13 % 97).alias("s"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 11).cast("double").alias("d"),
    )
    path, index = f"{tmp_path}/t", f"{tmp_path}/i"
    write_by_neighbourhood(rows, path, ["a", "s"], 32)
    assert spark.read.parquet(path).count() == 20_000
    build_index(spark, path, ["a", "b", "s", "d"], index, values=1000)
    table = spark.read.parquet(path)
    every = len(table.inputFiles())
    assert every > 16
    for equals in ({"a": 3}, {"a": 499, "b": 7}, {"s": "s5"}, {"b": 7}, {"d": 4.0}, {"a": 3, "d": 0.0}, {"a": 700}, {"s": "none"}):
        wanted = sorted(r["id"] for r in filtered_scan(table, equals, ["id"]).collect())
        assert sorted(r["id"] for r in skipping_scan(spark, path, index, equals, ["id"]).collect()) == wanted
    assert len(files_to_read(spark, table, index, {"a": 3})) <= every // 3
    assert len(files_to_read(spark, table, index, {"a": 3, "s": "s5"})) <= every // 6
    read = skipping_scan(spark, path, index, {"a": 3}, ["id"])
    assert len(read.inputFiles()) == len(files_to_read(spark, table, index, {"a": 3}))
    assert files_to_read(spark, table, index, {"a": 700}) == [] and files_to_read(spark, table, index, {"s": "none"}) == []
    with pytest.raises(ValueError):
        files_to_read(spark, table, index, {"id": 4})
    with pytest.raises(ValueError):
        write_by_neighbourhood(rows, path, [], 3)
