"""Running totals and ranks: the chunked way and a brute-force loop agree."""

import random

from assayloom.operators.ordered import previous_values, rows_at_ranks, running


def random_rows(seed, n=400):
    draw = random.Random(seed)
    # One key holds more than a third of all rows; a null key is a group of its own.
    return [
        (draw.choice(["hot", "hot", "a", "b", None]), draw.randint(0, 60), i, draw.randint(-5, 5)) for i in range(n)
    ]


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v int, id int, w int").repartition(5)


def test_running(spark):
    rows = random_rows(1)
    outputs = {"total": ("sum", "w"), "high": ("max", "w"), "high_before": ("max_before", "w")}
    result = running(table(spark, rows), ["k"], ["-v", "id"], outputs)
    found = {r["id"]: (r["total"], r["high"], r["high_before"]) for r in result.collect()}
    assert len(found) == len(rows)
    for key in {r[0] for r in rows}:
        total, high = 0, None
        for row in sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])):
            before, total = high, total + row[3]
            high = row[3] if high is None else max(high, row[3])
            assert found[row[2]] == (total, high, before)


def test_running_without_keys(spark):
    rows = random_rows(2)
    result = running(table(spark, rows), [], ["v", "id"], {"total": ("sum", "w")})
    found = {r["id"]: r["total"] for r in result.collect()}
    total = 0
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        total += row[3]
        assert found[row[2]] == total


def test_previous_values(spark):
    rows = random_rows(3)
    result = previous_values(table(spark, rows), ["v", "id"], {"earlier": "k"})
    found = {r["id"]: r["earlier"] for r in result.collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[2]))
    assert found[ordered[0][2]] is None
    for before, row in zip(ordered, ordered[1:]):
        assert found[row[2]] == before[0]


def test_rows_at_ranks(spark):
    rows = random_rows(4)
    wanted = {key: [1, 3, len([r for r in rows if r[0] == key])] for key in {r[0] for r in rows}}
    ranks = spark.createDataFrame(list(wanted.items()), "k string, ranks array<long>")
    result = rows_at_ranks(table(spark, rows), ["k"], ["v", "id"], ranks)
    found = {(r["k"], r["rank"]): r["id"] for r in result.collect()}
    for key, places in wanted.items():
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for place in places:
            assert found[(key, place)] == ordered[place - 1][2]


def test_weighted_ranks_without_keys(spark):
    rows = [(v, w) for v, w in zip(range(50), [3, 1, 7, 2, 5] * 10)]
    frame = spark.createDataFrame(rows, "v int, w long").repartition(4)
    flat = [v for v, w in rows for _ in range(w)]
    ranks = [1, 4, 5, 90, len(flat)]
    result = rows_at_ranks(frame, [], ["v"], ranks, weight="w")
    assert {r["rank"]: r["v"] for r in result.collect()} == {k: flat[k - 1] for k in ranks}
