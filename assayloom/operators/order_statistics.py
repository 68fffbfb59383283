"""Exact quantiles of a whole column in two scans, without sorting, shuffling or staging its rows.

The first scan builds Spark's mergeable quantile sketch, whose answers are at most 1/accuracy of the rows away from the wanted rank. Two
answers on either side of a rank so bracket it. The second scan counts what lies below each bracket and groups what lies inside by
value; the rank is then found among those few groups. How many rows a bracket can hold is known beforehand from the sketch's
bound; while that is too many, a further scan sketches the bracket alone, which narrows it by the same factor again. Values that repeat
are one group, however many rows they fill.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sketch's ranks are off by one row in so many at most.
ACCURACY = 10_000
#: Rows that the brackets may hold together when they are grouped by value and read on the driver; at least ``accuracy`` a rank.
HELD_ROWS = 200_000
#: Brackets reach so many times the sketch's error to either side.
_REACH = 2


def _around(share: float, accuracy: int) -> list[float]:
    return [max(0.0, share - _REACH / accuracy), min(1.0, share + _REACH / accuracy)]


def _sketched(value: Column, shares: Sequence[float], accuracy: int) -> Column:
    return F.percentile_approx(value, list(shares), accuracy)


def _bound(rows: int, accuracy: int) -> int:
    """Rows strictly inside a bracket sketched from so many rows, at most: its reach and the error of both ends."""
    return 2 * (_REACH + 1) * rows // accuracy + 2


def _narrowed(df: DataFrame, column: str, ranks: Sequence[int], brackets: list[tuple], accuracy: int) -> tuple[list[tuple], list[int]]:
    """Narrower brackets of the ranks, and the rows that each holds strictly inside at most.

    Rows at the ends of a bracket can be any number. A rank among them is found; any other is sketched strictly inside.
    """
    value = F.col(column)
    sizes = []
    for low, high in brackets:
        inside = (value > F.lit(low)) & (value < F.lit(high))
        sizes += [F.count_if(value < F.lit(low)), F.count_if(value <= F.lit(low)), F.count_if(inside)]
    counts = list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(sizes)]).first())
    out, held, asked = list(brackets), [0] * len(ranks), {}
    for i, (rank, (low, high)) in enumerate(zip(ranks, brackets)):
        below, upto, inside = counts[3 * i : 3 * i + 3]
        if rank <= below:
            raise AssertionError(f"the sketch's bracket from {low} to {high} misses rank {rank}: {below} below")
        if rank <= upto:
            out[i] = low, low
        elif rank > upto + inside:
            out[i] = high, high
        elif inside <= accuracy:
            held[i] = inside
        else:
            within = F.when((value > F.lit(low)) & (value < F.lit(high)), value)
            asked[i] = _sketched(within, _around((rank - upto) / inside, accuracy), accuracy).alias(f"q{i}")
            held[i] = _bound(inside, accuracy)
    if asked:
        found = df.agg(*asked.values()).first()
        for i in asked:
            out[i] = tuple(found[f"q{i}"])
    return out, held


def _located(df: DataFrame, column: str, ranks: Sequence[int], brackets: list[tuple]) -> list:
    """The values at the ranks: rows inside a bracket are grouped by value, others by the number of brackets below them."""
    value, within, gap = F.col(column), F.lit(False), F.lit(0)
    for low, high in brackets:
        within = within | ((value >= F.lit(low)) & (value <= F.lit(high)))
        gap = gap + (value > F.lit(high)).cast("int")
    kind = [F.when(within, value).alias("value"), F.when(~within, gap).alias("gap")]
    groups = df.where(value.isNotNull()).groupBy(*kind).agg(F.count(F.lit(1)).alias("n")).collect()
    # In order, rows between brackets come before the values of the next one.
    highs = sorted(high for _, high in brackets)
    steps = [((r["gap"], 0), None, r["n"]) for r in groups if r["value"] is None]
    steps += [((bisect_left(highs, r["value"]), 1, r["value"]), r["value"], r["n"]) for r in groups if r["value"] is not None]
    found, todo, upto = {}, sorted(set(ranks), reverse=True), 0
    for _, held, count in sorted(steps):
        upto += count
        while todo and todo[-1] <= upto:
            if held is None:
                raise AssertionError(f"rank {todo[-1]} lies in no bracket")
            found[todo.pop()] = held
    return [found[rank] for rank in ranks]


def quantiles(
    df: DataFrame,
    column: str,
    shares: Sequence[float],
    more: Sequence[Column] = (),
    accuracy: int = ACCURACY,
    held_rows: int = HELD_ROWS,
) -> tuple[int, list[float | None], list]:
    """Present values, their exact linearly interpolated quantiles, and the results of ``more`` aggregates of the first scan.

    ``column`` holds numbers without NaN; nulls are left out, and without any value the quantiles are null. The table is read twice,
    once more per narrowing: stage it first if it is dear to compute or not the same each time.
    """
    value, shares = F.col(column), list(shares)
    asked = [p for share in shares for p in _around(share, accuracy)]
    sketch = _sketched(value, asked, accuracy) if asked else F.lit(None)
    rows, sketched, low, high, *rest = df.agg(F.count(value), sketch, F.min(value), F.max(value), *more).first()
    if not rows or not shares:
        return rows, [None] * len(shares), rest
    places = [(rows - 1) * share for share in shares]
    ranks = [min(int(place) + step, rows) for place in places for step in (1, 2)]
    # In fewer rows than the accuracy the sketch's reach is less than a row; they are few enough to be grouped as they are.
    if rows <= accuracy:
        brackets, held = [(low, high)] * len(ranks), [rows]
    else:
        brackets = [(sketched[2 * i], sketched[2 * i + 1]) for i in range(len(shares)) for _ in (1, 2)]
        held = [_bound(rows, accuracy)] * len(ranks)
    while sum(held) > max(held_rows, accuracy * len(ranks)):
        brackets, held = _narrowed(df, column, ranks, brackets, accuracy)
    values = _located(df, column, ranks, brackets)
    out = []
    for i, place in enumerate(places):
        low, high = values[2 * i], values[2 * i + 1]
        out.append(low + (high - low) * (place - int(place)))
    return rows, out, rest
