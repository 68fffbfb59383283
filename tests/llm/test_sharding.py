import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.llm import sharding
from assayloom.llm.queries import QUERIES


def check(rows, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_sharding"](spark, folder).collect()
    check(rows, 40)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        k: (len(t) + 16, zlib.crc32(t)) for k, t in docs.items()
    }


def test_blocks_and_many_partitions(spark):
    docs = spark.range(1003).repartition(13).select("id")
    first = sharding.shuffle_into_shards(docs, shards=7, block_rows=20).select("row.id", "shard", "slot").collect()
    check(first, 7)
    assert sorted(r["id"] for r in first) == list(range(1003))


def test_odd_rows(odd, none):
    rows = sharding.shuffle_into_shards(odd, shards=5).select("row.*", "shard", "slot").collect()
    check(rows, 5)
    assert Counter(r["text"] for r in rows) == Counter(r["text"] for r in odd.collect())
    assert sharding.shuffle_into_shards(none).count() == 0


def test_few_rows(spark):
    check(sharding.shuffle_into_shards(spark.range(3), shards=10).collect(), 10)


def test_matrix_has_exact_margins():
    starts, targets = [0, 5, 5, 105, 1000], sharding.target_sizes(1000, 6, 2)
    rows = [sharding.matrix_row(starts, targets, p, 9) for p in range(4)]
    assert [int(r.sum()) for r in rows] == [5, 0, 100, 895]
    assert (sum(rows) == targets).all()


def test_assignment_is_uniform(spark):
    """Row 0 of the first partition goes to every shard about equally often over seeds."""
    starts, targets = [0, 10, 40, 60], sharding.target_sizes(60, 4, 1)
    seen = Counter()
    for seed in range(2000):
        labels = np.repeat(np.arange(4), sharding.matrix_row(starts, targets, 0, seed))
        seen[int(np.random.default_rng([seed, 2, 0]).permutation(labels)[0])] += 1
    assert all(400 < seen[s] < 600 for s in range(4))


@pytest.mark.parametrize("good,bad,draws", [(4 * 10**9, 6 * 10**9, 10**6), (3 * 10**9, 10, 5), (10**9, 10**9, 2 * 10**9 - 3)])
def test_large_populations(good, bad, draws):
    rng = np.random.default_rng(4)
    found = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(50)])
    total = good + bad
    mean = draws * good / total
    spread = max(1.0, (mean * bad / total * (total - draws) / (total - 1)) ** 0.5)
    assert (found <= min(good, draws)).all() and (found >= max(0, draws - bad)).all()
    assert abs(found.mean() - mean) < spread


def test_query_deals_whole_documents(spark, monkeypatch):
    """The operator gets the documents with their texts, and size and checksum are those of the rows it gives back."""
    folder, deal, seen = "/root/testdata/sf0.001", sharding.shuffle_into_shards, []

    def broken(docs, *more):
        seen.append(docs.columns)
        return deal(docs, *more).withColumn("row", F.col("row").withField("text", F.lit("lost")))

    monkeypatch.setattr(sharding, "shuffle_into_shards", broken)
    rows = QUERIES["op10_sharding"](spark, folder).collect()
    assert seen == [spark.read.parquet(f"{folder}/documents.parquet").columns]
    assert {(r["size"], r["text_crc32"]) for r in rows} == {(20, zlib.crc32(b"lost"))}


def test_rows_lie_in_their_shard(spark):
    """No two partitions hold rows of one target: the rows were exchanged, not only their numbers."""
    docs = spark.range(400).repartition(6).withColumn("text", F.concat(F.lit("text "), "id"))
    dealt = sharding.shuffle_into_shards(docs, shards=5)
    rows = dealt.select("row.*", "shard", "slot", F.spark_partition_id().alias("part")).collect()
    check(rows, 5)
    assert all(r["text"] == f"text {r['id']}" for r in rows)
    assert len({(r["shard"], r["part"]) for r in rows}) == 5


def test_long_texts_make_more_targets_and_the_same_sizes(spark):
    docs = spark.range(3_000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 AS int)) AS text")
    rows = sharding.shuffle_into_shards(docs, shards=7, block_bytes=2_000).select("row.doc_id", "shard", "slot").collect()
    assert len({r["doc_id"] for r in rows}) == 3_000
    for shard in range(7):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (428, 429)
    first = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))][:428]
    assert 1_000 < sum(first) / len(first) < 2_000
