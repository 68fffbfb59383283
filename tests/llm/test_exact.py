import hashlib
import re

import numpy as np
import pytest

from assayloom.llm import exact
from assayloom.llm.queries import ORACLE, QUERIES
from tests.compare import difference, oracle_connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, name):
    assert difference(QUERIES[name](spark, small), oracle_connection(small), ORACLE[name]) == ""


def test_odd_rows(odd, none):
    rows = exact.mark_duplicates(odd).collect()
    plain = {}
    for r in odd.collect():
        plain.setdefault(re.sub(r"[\x20\x09-\x0d]+", "", r["text"] or ""), []).append(r)
    assert len(rows) == odd.count()
    groups = {}
    for r in rows:
        groups.setdefault(r["text_sha256"], []).append(r)
    assert {hashlib.sha256(p.encode()).hexdigest(): len(g) for p, g in plain.items()} == {k: len(g) for k, g in groups.items()}
    for found in groups.values():
        assert sum(r["kept"] for r in found) == 1
        assert {r["group_size"] for r in found} == {len(found)}
        assert len({r["keep_id"] for r in found}) == 1
    by_key = {r["doc_id"]: r for r in rows}
    assert by_key[1]["keep_id"] == 1 and by_key[2]["keep_id"] == 1
    assert by_key[3]["keep_id"] == 5 and by_key[None]["keep_id"] is None and by_key[None]["kept"]
    assert exact.mark_duplicates(none).count() == 0


def test_null_key_stays_only_without_another(spark):
    docs = spark.createDataFrame([(None, "a b"), (5, "a b"), (None, "lone"), (None, "lone")], "doc_id long, text string")
    rows = exact.mark_duplicates(docs).collect()
    assert sorted((r["keep_id"] is None, r["kept"]) for r in rows) == [(False, False), (False, True), (True, False), (True, True)]


def test_filters_merge_without_loss(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(-50, 50, 5000) << 50
    rows = spark.createDataFrame([(int(v),) for v in values], "fp long").repartition(7)
    for bits in (0, 3, 11):
        merged = exact.merged_filters(exact.partition_filters(rows, "fp", bits), bits).collect()
        keys, counts = np.unique(values, return_counts=True)
        assert {r["fingerprint"]: r["n"] for r in merged} == dict(zip(keys.tolist(), counts.tolist()))


def test_counters_overflow_and_filters_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact, "HELD_FINGERPRINTS", 100)
    values = [7 << 40] * 70_000 + list(range(-300, 300)) * 3 + [-(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(v,) for v in values], "fp long").coalesce(2)
    for bits in (0, 1, 8, 13):
        filters = exact.partition_filters(rows, "fp", bits)
        found = {r["fingerprint"]: r["n"] for r in exact.merged_filters(filters, bits).collect()}
        assert found == {7 << 40: 70_000, **dict.fromkeys(range(-300, 300), 3), -(2**63): 1, 2**63 - 1: 1}
    keys, counts = np.array([5, 6, 2**40], np.uint64), np.array([254, 255, 10**12])
    assert [len(p) for p in exact.pack(keys, counts, 20)] == [18, 3, 16]


def test_millions_of_fingerprints_take_seconds(spark):
    """Twice the fingerprints take about twice the time, not four times."""
    import time

    import pyarrow as pa

    def seconds(count):
        rng = np.random.default_rng(count)
        batches = [pa.RecordBatch.from_arrays([pa.array(rng.integers(-(2**62), 2**62, 10_000))], names=["fp"]) for _ in range(count // 10_000)]
        held, build = [], {}

        class Rows:
            def select(self, *_):
                return self

            def mapInArrow(self, work, schema):
                build["work"] = work

        exact.partition_filters(Rows(), "fp", 7)
        start = time.process_time()
        held += build["work"](iter(batches))
        assert sum(len(c.as_py()) for b in held for c in b.column(2)) == count
        return time.process_time() - start

    seconds(100_000)
    assert seconds(2_000_000) < 10 and seconds(1_600_000) < 3.2 * max(seconds(800_000), 0.2)
