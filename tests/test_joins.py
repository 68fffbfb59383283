"""Keyed joins with and without hot keys, and the alignment guard."""

import pytest

from assayloom.operators.alignment import aligned_join, alignment_report, keep_surviving, require_aligned
from assayloom.operators.spread import hot_keys, spread_join


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i % 40}", i) for i in range(600)], "k string, i int")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)], "k string, v int")
    return left.repartition(4), right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(sides, how):
    left, right = sides
    hot = hot_keys(left, ["k"], hot_rows=50)
    assert [r["k"] for r in hot.collect()] == ["hot"]
    spread = spread_join(left, right, ["k"], ["i"], hot, how)
    plain = left.join(right, "k", how)
    assert spread.columns == plain.columns
    assert sorted(map(tuple, spread.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_no_hot_keys(sides):
    assert hot_keys(sides[0], ["k"]).count() == 0




def test_alignment(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (5, "d")], "id int, x string")
    right = spark.createDataFrame([(1, 0.1), (2, 0.2), (9, 0.9)], "id int, y double")
    assert alignment_report(left, right, "id").first().asDict() == {
        "left_only": 1, "right_only": 1, "repeated": 1, "matched": 2
    }
    with pytest.raises(ValueError, match="not aligned"):
        require_aligned(left, right, "id")
    same = left.where("x in ('a', 'b')")
    require_aligned(same, right.where("id < 9"), "id")
    assert {tuple(r) for r in aligned_join(same, right, "id").collect()} == {(1, "a", 0.1), (2, "b", 0.2)}
    kept = keep_surviving(left, right, "id", hot_rows=1)
    assert {tuple(r) for r in kept.collect()} == {(1, "a"), (2, "b"), (2, "c")}
