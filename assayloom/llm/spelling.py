"""Spelling variants by a dictionary of trie-node pairs.

All words form a trie, all reversed words another, and the nodes of both are numbered. A place in a word is then a pair of integers:
the node of what stands before it and, in the reversed trie, of what stands behind it. Two words are neighbours (one
inserted, deleted or replaced code point) exactly when such pairs meet:

* the pair around a skipped place of a word equals the pair around a skipped place of another: they differ there only;
* the pair around a skipped place of a word equals the pair at a place between two letters of another, which is the word
  without that letter. Of a run of equal letters only the last is skipped for this, so a neighbour is met once.

A pair is exact, not a hash, so nothing has to be verified. The words of a pair differ in one code point, so a group is never larger
than the alphabet; it is summed up (how many, the two best) and never written out as pairs of words.

The tries are numbered as words come in sorted order: a word shares the nodes of its common beginning with the word before and
opens new ones for the rest. Ranges of the order are numbered apart. What reaches from one range into the next is a beginning
of the range's last word, so its number is made of the range and the depth, and the next range knows it from the last words alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.rows import map_batches
from assayloom.staging import stage

#: How many times more often than a word its form has to occur.
RATIO = 10
_RANGE, _SHARED = 40, 1 << 39


def common(left: str, right: str) -> int:
    """Length of the common beginning."""
    for i, (a, b) in enumerate(zip(left, right)):
        if a != b:
            return i
    return min(len(left), len(right))


class Numbering:
    """Node numbers along one range of sorted words; ``lasts`` has the last word of every range up to this one."""

    def __init__(self, number: int, lasts: list[str]) -> None:
        self.base, self.lasts, self.number = number << _RANGE, lasts, number
        self.words = self.opened = 0
        self.word, self.nodes = None, []

    def _inherited(self, word: str) -> list[int]:
        """Numbers of the word's beginnings that earlier ranges have opened."""
        if not self.number:
            return []
        shared = common(word, self.lasts[self.number - 1])
        nodes, owner = [0] * (shared + 1), self.number - 1
        for depth in range(shared, -1, -1):
            while owner and self.lasts[owner - 1].startswith(word[:depth]):
                owner -= 1
            nodes[depth] = owner << _RANGE | _SHARED | depth
        return nodes

    def add(self, word: str) -> tuple[int, list[int]]:
        """The word's number, which keeps the order of the words, and the nodes of its beginnings, the empty one first."""
        if self.word is None:
            nodes = self._inherited(word)
        else:
            nodes = self.nodes[: common(word, self.word) + 1]
        shared = common(word, self.lasts[self.number])
        for depth in range(len(nodes), len(word) + 1):
            if depth <= shared:
                nodes.append(self.base | _SHARED | depth)
            else:
                nodes.append(self.base | self.opened)
                self.opened += 1
        self.word, self.nodes = word, nodes
        self.words += 1
        return self.base | (self.words - 1), nodes


def trie_nodes(words: DataFrame, backwards: bool = False) -> DataFrame:
    """``word, n, id, nodes, ends``: a long per word that keeps their order, the numbers of the nodes from the root to the word in
    the trie (of the words read backwards, if so wanted), and whether each letter is the last of a run of equal ones.

    ``words`` has different words in ``word`` and any longs in ``n``. The driver sees one word per range.
    """
    spelled = words.select(F.reverse("word").alias("spelled") if backwards else F.col("word").alias("spelled"), "n")
    ranged = stage(spelled.repartitionByRange("spelled").withColumn("range", F.spark_partition_id()), "sorted-words")
    found = {r["range"]: r["last"] for r in ranged.groupBy("range").agg(F.max("spelled").alias("last")).collect()}
    numbers = {number: i for i, number in enumerate(sorted(found))}
    lasts = [found[number] for number in sorted(found)]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Numbering | None = None
        for batch in batches:
            spelled = batch.column(1).to_pylist()
            ids, flat, sizes, ends = [], [], [0], []
            for part, word in zip(batch.column(0).to_pylist(), spelled):
                if state is None or state.number != numbers[part]:
                    state = Numbering(numbers[part], lasts)
                own, nodes = state.add(word)
                ids.append(own)
                flat += nodes
                sizes.append(len(flat))
                ends += [a != b for a, b in zip(word, word[1:])]
                ends.append(True)
            if not ids:
                continue
            sizes = np.array(sizes, np.int32)
            letters = sizes - np.arange(len(sizes), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w[::-1] for w in spelled] if backwards else spelled, pa.string()),
                    batch.column(2),
                    pa.array(ids, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, pa.int64())),
                    pa.ListArray.from_arrays(pa.array(letters), pa.array(ends, pa.bool_())),
                ],
                names=["word", "n", "id", "nodes", "ends"],
            )

    placed = ranged.select("range", "spelled", "n").repartitionById(max(numbers, default=0) + 1, "range")
    ordered = placed.sortWithinPartitions("range", "spelled")
    return map_batches(ordered, "word string, n long, id long, nodes array<long>, ends array<boolean>", number, rows=1024)


def _places(words: DataFrame) -> DataFrame:
    """``before, behind, kind, id, n``: kind 0 for a place between letters, 1 for a skipped letter, 2 if it ends its run."""
    size = F.size("nodes") - 1
    kind = lambda i: F.when(F.get("ends", i), 2).otherwise(1)
    pair = lambda i, rest, k: F.struct(
        F.get("nodes", i).alias("before"), F.get("back", rest).alias("behind"), k.alias("kind")
    )
    skipped = F.transform(F.sequence(F.lit(0), size - 1), lambda i: pair(i, size - 1 - i, kind(i)))
    between = F.transform(F.sequence(F.lit(0), size), lambda i: pair(i, size - i, F.lit(0)))
    return words.select(F.explode(F.concat(skipped, between)).alias("at"), "id", "n").select("at.*", "id", "n")


def _neighbours(places: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many neighbours a word has, and the one of largest n (then of smallest id)."""
    group = Window.partitionBy("before", "behind")
    ranked = group.orderBy((F.col("kind") > 0).desc(), F.col("n").desc(), "id")
    over = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("n", (-F.col("id")).alias("minus"))
    skips = F.col("kind") > 0
    met = places.withColumns(
        {
            "rank": F.row_number().over(ranked),
            "skips": F.sum(skips.cast("long")).over(over),
            "ends": F.sum((F.col("kind") == 2).cast("long")).over(over),
            "shorter": F.max(F.when(F.col("kind") == 0, one)).over(over),
            "longer": F.max(F.when(F.col("kind") == 2, one)).over(over),
            "first": F.first(F.when(skips, one)).over(over),
            "second": F.nth_value(F.when(skips, one), 2).over(over),
        }
    )
    other = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("first"))
    has_shorter = (F.col("kind") == 2) & F.col("shorter").isNotNull()
    near = F.when(F.col("kind") == 0, F.col("ends")).otherwise(F.col("skips") - 1 + has_shorter.cast("long"))
    best = F.when(F.col("kind") == 0, F.col("longer")).when(has_shorter, F.greatest(other, "shorter")).otherwise(other)
    met = met.select("id", near.alias("near"), best.alias("best")).where("near > 0")
    return met.groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """``id, root`` for every ``id, up``, following links to their end. A link leads to a word ``RATIO`` times as frequent, so a chain
    has at most 19 links and five rounds, which double the way, reach its end."""
    while True:
        ahead = links.select(F.col("id").alias("up"), F.col("up").alias("further"))
        jumped = stage(links.join(ahead, "up", "left"), "forms")
        moved = jumped.where("further IS NOT NULL").limit(1).count()
        links = jumped.select("id", F.coalesce("further", "up").alias("up"))
        if not moved:
            return links.withColumnRenamed("up", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every different ``word`` (not null) with its count ``n``.

    Words are near if they differ by one inserted, deleted or replaced code point. ``form`` is the near word of largest n, of several
    the smallest, if it occurs at least ``ratio`` (2 or more) times as often, else null; ``root`` follows forms to the last. An
    empty table gives an empty result; a word of any length and the empty word are words.
    """
    if ratio < 2:
        raise ValueError("ratio has to be 2 or more")
    counted = words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    counted = stage(counted, "words")
    back = trie_nodes(counted, backwards=True).select("word", F.col("nodes").alias("back"))
    known = stage(trie_nodes(counted).join(back, "word"), "word-nodes")
    near = _neighbours(_places(known))
    known = known.select("id", "word", "n")
    form = F.when(F.col("best.n") >= ratio * F.col("n"), -F.col("best.minus"))
    judged = stage(known.join(near, "id", "left").withColumn("up", form), "near-words")
    roots = _roots(judged.where("up IS NOT NULL").select("id", "up"))
    names = known.select(F.col("id").alias("up"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    ends = known.select(F.col("id").alias("root"), F.col("word").alias("last"))
    formed = judged.where("up IS NOT NULL").select("id", "up").join(roots, "id").join(names, "up").join(ends, "root")
    joined = judged.drop("up").join(formed.select("id", "form", "form_n", "last"), "id", "left")
    return joined.select(
        "word",
        "form",
        F.coalesce("last", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form_n",
    )
