"""Group split against the literal greedy walk, and its invariants."""

import random

import pytest

from assayloom.operators.split import fill_by_size, group_split, leaked_groups, rank_in_size_class, group_sizes


def greedy(groups):
    """Split per group from (size, first, name), walking the groups one by one."""
    rows = sum(size for size, _, _ in groups)
    train = valid = 0
    found = {}
    for size, _, name in sorted(groups, reverse=True):
        if train + size <= rows * 8 // 10:
            train, found[name] = train + size, "train"
        elif train + valid + size <= rows * 9 // 10:
            valid, found[name] = valid + size, "valid"
        else:
            found[name] = "test"
    return found


def test_closed_form_equals_greedy_walk():
    draw = random.Random(5)
    for _ in range(1500):
        most = draw.choice([1, 3, 12, 200])
        sizes = [draw.randint(1, most) for _ in range(draw.randint(1, 40))]
        walked = greedy([(size, i, i) for i, size in enumerate(sizes)])
        histogram = {s: sizes.count(s) for s in sizes}
        for size, groups, to_train, to_valid in fill_by_size(histogram.items()):
            splits = [walked[i] for i, s in enumerate(sizes) if s == size]
            assert (groups, to_train, to_valid) == (len(splits), splits.count("train"), splits.count("valid"))


CASES = {
    "one group": [50],
    "singletons": [1] * 37,
    "equal groups": [10] * 10,
    "mixed": [9, 5, 5, 3, 2, 2, 1, 1, 1, 1],
    "one row": [1],
    "hot group": [60] + [1] * 80 + [2] * 20,
}


@pytest.mark.parametrize("sizes", CASES.values(), ids=CASES.keys())
@pytest.mark.parametrize("hot_rows", [1_000_000, 5])
def test_group_split(spark, sizes, hot_rows):
    draw = random.Random(11)
    names = [f"g{i}" for i, size in enumerate(sizes) for _ in range(size)]
    draw.shuffle(names)
    rows = list(enumerate(names))
    frame = spark.createDataFrame(rows, "i int, g string").repartition(4)
    result = group_split(frame, "g", ["i"], hot_rows=hot_rows).collect()
    assert sorted(r["i"] for r in result) == list(range(len(rows)))
    groups = [(names.count(g), names.index(g), g) for g in set(names)]
    expected = greedy(groups)
    assert {r["g"]: r["split"] for r in result} == expected
    assert all(r["split"] == expected[r["g"]] for r in result)
    assert sum(r["split"] == "train" for r in result) <= len(rows) * 8 // 10


def test_empty(spark):
    frame = spark.createDataFrame([], "i int, g string")
    assert group_split(frame, "g", ["i"]).collect() == []


def test_leaks(spark):
    frame = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "valid")], "g string, split string")
    assert [r["g"] for r in leaked_groups(frame, "g").collect()] == ["a"]


def test_rank_in_size_class(spark):
    frame = spark.createDataFrame([(i, f"g{i % 90 if i < 180 else i}") for i in range(300)], "i int, g string")
    sizes = group_sizes(frame, "g", ["i"])
    ranks = {r["g"]: r["class_rank"] for r in rank_in_size_class(sizes, "g").collect()}
    assert ranks["g299"] == 1 and ranks["g89"] == 1
    assert sorted(ranks[f"g{i}"] for i in range(90)) == list(range(1, 91))


def test_rows_without_a_group_are_one_group(spark):
    frame = spark.createDataFrame([(i, None if i % 3 == 0 else f"g{i}") for i in range(30)], "i int, g string")
    for hot_rows in (1_000_000, 2):
        result = group_split(frame, "g", ["i"], hot_rows=hot_rows).collect()
        assert sorted(r["i"] for r in result) == list(range(30))
        assert len({r["split"] for r in result if r["g"] is None}) == 1
