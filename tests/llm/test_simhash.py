import random

import numpy as np
import pytest
import xxhash

from assayloom.llm import graph, simhash
from assayloom.llm.queries import QUERIES


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints):
    """Union of all pairs within three bits, by brute force over distinct fingerprints."""
    distinct = sorted(set(fingerprints.values()))
    values = np.array(distinct, np.uint64)
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            parent[find(int(j))] = find(i)
    place = {v: i for i, v in enumerate(distinct)}
    least = {}
    for key, value in fingerprints.items():
        root = find(place[value])
        least[root] = min(least.get(root, key), key)
    return {key: least[find(place[value])] for key, value in fingerprints.items()}


def test_code_is_perfect():
    words = np.arange(1 << 23)
    index, counts = np.unique(simhash.index_of(words), return_counts=True)
    assert len(index) == 4096 and set(counts) == {2048}


def test_near_indices_are_six_at_most_and_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 20_000)
    near, filled = simhash.near_indices(words, 23)
    assert set(filled.sum(axis=1)) == {1, 6}
    flipped = simhash.index_of(words ^ (1 << rng.integers(0, 23, len(words))))
    assert ((near == flipped[:, None]) & filled).any(axis=1).all()


def test_every_pair_within_three_bits_shares_a_key():
    rng = random.Random(2)
    values, others = [], []
    for _ in range(3000):
        value = rng.getrandbits(64)
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        values.append(value)
        others.append(value ^ flips)
    near, real = simhash.near_keys(np.array(values, np.uint64).view(np.int64))
    plain = simhash.plain_keys(np.array(others, np.uint64).view(np.int64))
    for a, exist, b in zip(near, real, plain):
        assert set(a[exist]) & set(b)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 160)]
    links = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in graph.components(links, "a", "b").collect()}
    assert roots == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
    assert graph.components(links.limit(0), "a", "b").count() == 0


def test_links_of_planted_fingerprints(spark):
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        value = rng.getrandbits(64)
        for _ in range(6):
            values.add(value)
            value ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    values = sorted(values)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    found = {tuple(r) for r in simhash.links_between(spark.createDataFrame(rows, "rep long, fp long")).collect()}
    wanted = {
        (i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin(values[i] ^ values[j]).count("1") <= 3
    }
    assert found == wanted and wanted


def test_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    texts = [r["text"] for r in odd.collect()]
    assert len(rows) == len(texts)
    assert sorted(r["fingerprint"] for r in rows) == sorted(f"{plain_fingerprint(t):016x}" for t in texts)
    assert {r["component_id"] for r in rows if r["doc_id"] in (3, 4, 5)} == {3}
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 10)} == {1}
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    wanted = {k: plain_fingerprint(t) for k, t in docs.items()}
    got = {r["doc_id"]: r for r in QUERIES["op2_near_duplicates"](spark, folder).collect()}
    assert {k: r["fingerprint"] for k, r in got.items()} == {k: f"{v:016x}" for k, v in wanted.items()}
    assert {k: r["component_id"] for k, r in got.items()} == plain_components(wanted)
