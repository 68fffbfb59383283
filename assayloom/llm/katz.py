"""Katz backoff: Good-Turing discounted word-pair counts with exactly normalised backoff weights.

The probability of a word after another is its discounted pair count if the pair was seen, else the backoff weight of the
first word times the lower-order probability of the second; the lower order is the discounted word count, and what discounting
frees there is the probability of the unknown word. Every word that the training texts have twice or more has pairs of its own,
at any corpus size; words seen once and unknown words are one class in pairs, and within the class the lower order holds. So no
count is dropped, and every conditional distribution sums to one over all known words and the unknown one.

Texts are read once. Every task codes its tokens, in chunks, by the chunk's own dictionary and keeps the codes. Per chunk and
hash bucket it *asks* for the counts of its distinct words, later of its distinct pairs and of what it needs of their histories.
A bucket adds up what all chunks sent (the count table, partitioned by bucket) and *answers* every chunk in the order it asked, in
one task and from one exchange. So counting and looking up move distinct entries per chunk instead of tokens, and no word, pair or
history is ever hot. A bucket's task holds its distinct entries and its requests as they came, compressed; buckets are sized by the
text. The driver holds numbers per bucket and per count, no words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.llm.labelled import fold
from assayloom.llm.rows import TEXT_ROWS, map_batches, text_of, whole
from assayloom.staging import stage

FOLDS, HELD_OUT = 10, 0
#: Words have pairs of their own from a training share of 1 / this and two occurrences on; no share by default.
VOCABULARY = math.inf
#: Counts up to this one are discounted.
MOST_DISCOUNTED = 5
#: Tokens per chunk, and bytes of text per bucket.
CHUNK_TOKENS = 2_000_000
BUCKET_BYTES = 16 << 20
MOST_BUCKET_BITS = 24
#: Counts that wait in a bucket before they are added up, and requests that are answered together.
MOST_WAITING = 1_000_000
REQUESTS = 4_096
#: Shares of less are none: a history that all words followed needs no backoff, one whose counts free nothing frees one in n + 1.
SLIGHT = 1e-9
#: Additive part of the base score.
ADDED = 0.1
END = b""


def squeezed(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread_out(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeezed_steps(values: np.ndarray) -> bytes:
    """64-bit numbers by the steps between them, which are small where the numbers climb."""
    return squeezed(np.diff(values.view(np.uint64), prepend=np.uint64(0)))


def climbed(blob: bytes) -> np.ndarray:
    return np.cumsum(spread_out(blob, np.uint64), dtype=np.uint64)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def mixed(keys: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit keys, to deal them out evenly."""
    z = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """``buckets`` is sorted, so each is a slice."""
    found, starts = np.unique(buckets, return_index=True)
    for bucket, a, b in zip(found.tolist(), starts, np.append(starts[1:], len(buckets))):
        yield bucket, slice(a, b)


def _pair_order(pairs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending keys by bucket, then by key, and the buckets in it."""
    buckets = (mixed(pairs) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int32)
    order = np.argsort(buckets, kind="stable")
    return order, buckets[order]


_CODED = (
    "chunk long, keys array<long>, sizes binary, trains binary, codes binary, tokens long, train_tokens long, "
    "bucket int, entries binary, counts binary"
)


def coded(docs: DataFrame, bits: int) -> DataFrame:
    """Per chunk one row with its documents' codes, and a row per bucket that asks for its distinct words.

    ``docs`` has key, train and text. A word's code is the rank of its hash among the chunk's words, so the answers of all
    buckets, end to end, are the counts by code.
    """
    names = [f.split()[0] for f in _CODED.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3, *[pa.int64()] * 2, pa.int32(), *[pa.binary()] * 2]

    def rows(chunk: int, keys: list, sizes: list, trains: list, codes: list, known: _Codes) -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in known], np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        ranked = rank[np.concatenate(codes)]
        trained = np.repeat(np.array(trains, bool), sizes)
        counts, hashes = np.bincount(ranked[trained], minlength=len(order)), hashes[order]
        size, flags = squeezed(np.array(sizes, np.int32)), squeezed(np.array(trains, np.uint8))
        out = [(chunk, keys, size, flags, squeezed(ranked), len(ranked), int(trained.sum()), None, None, None)]
        for bucket, part in _by_bucket(hashes >> np.uint64(64 - bits)):
            asked = squeezed_steps(hashes[part]), squeezed(counts[part].astype(np.int64))
            out.append((chunk, None, None, None, None, None, None, bucket, *asked))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, tokens = TaskContext.get().partitionId() << 24, ([], [], [], []), 0
        known = _Codes()
        for batch in batches:
            for key, train, text in zip(*[whole(batch, n) for n in ("key", "train", "text")]):
                words = [*text.encode("utf-8").lower().split(), END]
                for column, value in zip(held, (key, len(words), train, np.fromiter(map(known.__getitem__, words), np.int32, len(words)))):
                    column.append(value)
                tokens += len(words)
                if tokens >= CHUNK_TOKENS:
                    yield rows(chunk, *held, known)
                    chunk, held, tokens, known = chunk + 1, ([], [], [], []), 0, _Codes()
        if tokens:
            yield rows(chunk, *held, known)

    return map_batches(docs, _CODED, work, TEXT_ROWS)


class _Totals:
    """Counts, and a note each, by entry. What comes in is added up from time to time, so memory follows the distinct entries."""

    def __init__(self) -> None:
        self.found, self.n, self.notes = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, entries: np.ndarray, counts: np.ndarray, notes: np.ndarray) -> None:
        kept = counts > 0
        self.waiting.append((entries[kept], counts[kept], notes[kept]))
        self.size += int(kept.sum())
        if self.size > max(len(self.found), MOST_WAITING):
            self.settle()

    def settle(self) -> None:
        entries, counts, notes = (np.concatenate(c) for c in zip((self.found, self.n, self.notes), *self.waiting))
        self.found, first, inverse = np.unique(entries, return_index=True, return_inverse=True)
        self.n, self.notes = np.zeros(len(self.found), np.int64), notes[first]
        np.add.at(self.n, inverse, counts)
        self.waiting, self.size = [], 0


_TABLE = (
    "chunk long, bucket int, entries binary, n binary, note binary, types long, own long, below long, small array<long>"
)


def count_table(asked: DataFrame, least: int | None = None) -> DataFrame:
    """Per bucket all entries that any chunk asked for, with their training counts ``n`` and notes, and the answers to all chunks.

    A row without a chunk is a part of the table. Entries without a count are left out. The note is the one the entry came with or,
    given ``least``, its rank among the bucket's entries with that count, -1 for the others. Beside them stand how many entries
    there are, how many have that count, what the others count together, and how many entries have count 1, 2, ...

    A row with a chunk answers its request: counts in the order asked, 0 where there are none, and given ``least`` the notes
    too. So a request is exchanged once for counting and answering. While a bucket is counted its task holds what was asked in
    the compressed form that it came in, which is bounded by the bucket's share of the text, and the distinct entries.
    """
    names = ["chunk", "bucket", "entries", "counts", *(["notes"] if least is None else [])]
    fields = [f.split()[0] for f in _TABLE.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 3, pa.list_(pa.int64())]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields)

    def settled(bucket: int, totals: _Totals, requests: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        totals.settle()
        own = totals.n >= (least or 0)
        notes = totals.notes if least is None else np.where(own, np.cumsum(own) - 1, -1)
        rows = []
        for at in range(0, len(totals.found), MOST_WAITING):
            part = slice(at, at + MOST_WAITING)
            n, mine = totals.n[part], own[part]
            small = np.bincount(n[n <= MOST_DISCOUNTED + 1], minlength=MOST_DISCOUNTED + 2)[1:].tolist()
            blobs = squeezed_steps(totals.found[part]), squeezed(n), squeezed(notes[part])
            rows.append((None, bucket, *blobs, len(n), int(mine.sum()), int(n[~mine].sum()), small))
        yield packed(rows)
        known = np.append(totals.found, np.uint64(0))
        held = [np.append(c, 0) for c in ((totals.n,) if least is None else (totals.n, notes))]
        for start in range(0, len(requests), REQUESTS):
            rows = []
            for chunk, blob in requests[start : start + REQUESTS]:
                entries = climbed(blob)
                at = np.searchsorted(known[:-1], entries)
                seen = known[at] == entries
                values = [squeezed(np.where(seen, value[at], 0)) for value in held]
                rows.append((chunk, bucket, None, *values, *[None] * (6 - len(values))))
            yield packed(rows)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, totals, requests = None, _Totals(), []
        for batch in batches:
            for chunk, bucket, entries, counts, *notes in zip(*[whole(batch, c) for c in names]):
                if bucket != current:
                    if current is not None:
                        yield from settled(current, totals, requests)
                    current, totals, requests = bucket, _Totals(), []
                n = spread_out(counts, np.int64)
                totals.add(climbed(entries), n, spread_out(notes[0], np.int64) if notes else np.zeros_like(n))
                requests.append((chunk, entries))
        if current is not None:
            yield from settled(current, totals, requests)

    together = asked.select(*names).repartition("bucket").sortWithinPartitions("bucket")
    return map_batches(together, _TABLE, add, REQUESTS)


def counted(asked: DataFrame, label: str, least: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The staged table of :func:`count_table`, and its answers: ``chunk, bucket, n`` and, given ``least``, ``note``."""
    both = stage(count_table(asked, least), label)
    values = ["n"] if least is None else ["n", "note"]
    return both.where("chunk IS NULL").drop("chunk"), both.where("chunk IS NOT NULL").select("chunk", "bucket", *values)


def answers(asked: DataFrame, table: DataFrame, *values: str, read: Callable[[bytes], np.ndarray] = climbed) -> DataFrame:
    """``chunk, bucket`` and per value a blob: a row for each request, its values in the order it asked, 0 where there are none.

    In a bucket the table's rows come first and are held; the requests, decoded by ``read``, then pass by and are answered one
    by one.
    """
    none = F.lit(None)
    empty = [none.cast("binary").alias(v) for v in values]
    counted = table.select("bucket", F.lit(0).alias("turn"), none.cast("long").alias("chunk"), "entries", *values)
    asking = asked.select("bucket", F.lit(1).alias("turn"), "chunk", "entries", *empty)
    together = counted.unionByName(asking).repartition("bucket").sortWithinPartitions("bucket", "turn")

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, known, held = None, [], None, []
        for batch in batches:
            buckets, turns = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = np.flatnonzero(np.diff(buckets.astype(np.int64) * 2 + turns, prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(buckets)]):
                if buckets[a] != current:
                    current, parts, known = buckets[a], [], None
                rows = batch.slice(a, b - a)
                if turns[a] == 0:
                    for entries, *blobs in zip(*[rows.column(i).to_pylist() for i in range(3, 4 + len(values))]):
                        parts.append([climbed(entries), *[spread_out(blob, np.int64) for blob in blobs]])
                    continue
                if known is None:
                    own, *rest = zip(*parts) if parts else [()] * (1 + len(values))
                    own = np.concatenate([np.empty(0, np.uint64), *own])
                    order, parts = np.argsort(own), []
                    known = np.append(own[order], np.uint64(0))
                    held = [np.append(np.concatenate([np.empty(0, np.int64), *c])[order], 0) for c in rest]
                found: list[list[bytes]] = [[] for _ in values]
                for blob in rows.column(3).to_pylist():
                    entries = read(blob)
                    at = np.searchsorted(known[:-1], entries)
                    for blobs, value in zip(found, held):
                        blobs.append(squeezed(np.where(known[at] == entries, value[at], 0)))
                columns = [rows.column(2), pa.array(np.full(b - a, current, np.int32)), *[pa.array(f, pa.binary()) for f in found]]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "bucket", *values])

    return map_batches(together, ", ".join(["chunk long, bucket int", *[f"{v} binary" for v in values]]), reply, REQUESTS)


def by_chunk(replies: DataFrame, label: str) -> DataFrame:
    """``chunk, <label>``: all replies to a chunk as structs in bucket order."""
    rest = [c for c in replies.columns if c != "chunk"]
    return replies.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(label))


def _ranks(blob: bytes) -> np.ndarray:
    return spread_out(blob, np.uint64)


def _answered(cell: list[dict], value: str, kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[spread_out(r[value], kind) for r in cell]])


def discounts(counts_of_counts: Sequence[int]) -> np.ndarray:
    """Factor per count 0..``MOST_DISCOUNTED`` (0 unused) from how many entries have count 1, 2, ...

    Good-Turing in Katz's form; where the counts of counts are too few or too ragged for it, absolute discounting.
    """
    n, most = [0, *counts_of_counts], MOST_DISCOUNTED
    out = np.ones(most + 1)
    if all(n[1 : most + 2]):
        rest = (most + 1) * n[most + 1] / n[1]
        if rest < 1:
            turing = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, most + 1)]
            if all(0 < d < 1 for d in turing):
                out[1:] = turing
                return out
    taken = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out[1:] = [(r - taken) / r for r in range(1, most + 1)]
    return out


def _counts_of_counts(table: DataFrame) -> list[int]:
    return [n or 0 for n in table.agg(*[F.sum(F.col("small")[r]) for r in range(MOST_DISCOUNTED + 1)]).first()]


@dataclass
class Lower:
    """The lower order: what a count is worth, and the ids of the words with own pairs, counted through the buckets."""

    tokens: int
    types: int
    factor: np.ndarray
    unknown: float
    #: Probability of all words without own pairs together.
    others: float
    #: Words with own pairs before each bucket, and in all.
    starts: np.ndarray

    @property
    def rare(self) -> int:
        return int(self.starts[-1])

    @property
    def start(self) -> int:
        return self.rare + 1

    @property
    def width(self) -> int:
        return self.rare + 2

    def chance(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by their training count; count 0 is the unknown word."""
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, discounted(counts, self.factor) / self.tokens, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.tokens + ADDED * (self.types + 1)))


def discounted(counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return np.where(counts < len(factor), factor[np.minimum(counts, len(factor) - 1)], 1.0) * counts


def least_count(tokens: int, vocabulary: float) -> int:
    """The training count from which on a word has pairs of its own."""
    return int(max(2, -(-tokens // vocabulary)))


def lower_order(words: DataFrame, tokens: int, least: int, bits: int) -> Lower:
    """From the word count table; what is collected is a number per bucket."""
    n = _counts_of_counts(words)
    factor = discounts(n)
    freed = [r * n[r - 1] * (1 - factor[r]) for r in range(1, MOST_DISCOUNTED + 1)]
    types, below = (n or 0 for n in words.agg(F.sum("types"), F.sum("below")).first())
    own = np.zeros((1 << bits) + 1, np.int64)
    for row in words.groupBy("bucket").agg(F.sum("own").alias("own")).collect():
        own[row["bucket"] + 1] = row["own"]
    unknown = sum(freed) / tokens if tokens else 1.0
    others = unknown + (below - sum(freed[: least - 1])) / tokens if tokens else 1.0
    return Lower(tokens, types, factor, unknown, others, np.cumsum(own))


@dataclass
class Higher:
    """The pair level: what a pair count is worth, and scale and backoff weight of the two histories that are no words."""

    factor: np.ndarray
    rare: tuple[float, float]
    start: tuple[float, float]


def histories(pairs: DataFrame, lower: Lower, factor: np.ndarray) -> DataFrame:
    """``bucket, entries, scale, backoff``: the histories of a bucket of words, by their ranks there.

    The scale is the probability of a discounted count of one. The bucket after the last one has
    the class of rare words (0) and the start (1). Tasks add up what they read of the pair table before it is exchanged.
    """
    shared = pairs.sparkSession.sparkContext.broadcast((lower, factor))
    kinds = {"ranks": np.int64, "n": np.int64, "kept": np.float64, "covered": np.float64}

    def part(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        lower, factor = shared.value
        keys, n, notes = (np.concatenate(c) for c in zip(*held))
        found, inverse = np.unique(keys // lower.width, return_inverse=True)
        chance = np.where(notes > 0, lower.chance(notes), lower.others)
        sums = [np.bincount(inverse, n).astype(np.int64), np.bincount(inverse, discounted(n, factor)), np.bincount(inverse, chance)]
        buckets = np.searchsorted(lower.starts, found, side="right") - 1
        ranks = found - lower.starts[buckets]
        here, cuts = np.unique(buckets, return_index=True)
        ends = [*cuts[1:].tolist(), len(found)]
        blobs = [pa.array([squeezed(c[a:b]) for a, b in zip(cuts, ends)], pa.binary()) for c in (ranks, *sums)]
        return pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), *blobs], names=["bucket", *kinds])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for entries, *blobs in zip(*[whole(batch, c) for c in ("entries", "n", "note")]):
                held.append([climbed(entries).view(np.int64), *[spread_out(b, np.int64) for b in blobs]])
                size += len(held[-1][0])
                if size >= MOST_WAITING:
                    yield part(held)
                    held, size = [], 0
        if size:
            yield part(held)

    def settled(bucket: int, held: list[np.ndarray]) -> pa.RecordBatch:
        n, kept, covered = held
        seen = np.flatnonzero(n)
        n, kept, covered = n[seen], kept[seen], covered[seen]
        freed, open_share = 1 - kept / n, 1 - covered
        closed = open_share <= SLIGHT
        freed = np.where(closed, 0.0, np.where(freed <= SLIGHT, 1 / (n + 1), freed))
        scale, backoff = (1 - freed) / kept, freed / np.where(closed, 1.0, open_share)
        blobs = squeezed_steps(seen.astype(np.int64)), squeezed(scale), squeezed(backoff)
        columns = [pa.array([bucket], pa.int32()), *[pa.array([b], pa.binary()) for b in blobs]]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "entries", "scale", "backoff"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, starts = None, [], shared.value[0].starts
        for batch in batches:
            for bucket, *blobs in zip(*[whole(batch, c) for c in ("bucket", *kinds)]):
                if bucket != current:
                    if current is not None:
                        yield settled(current, held)
                    own = 2 if bucket == len(starts) - 1 else int(starts[bucket + 1] - starts[bucket])
                    current, held = bucket, [np.zeros(own) for _ in range(3)]
                ranks, *sums = (spread_out(b, kind) for b, kind in zip(blobs, kinds.values()))
                for total, more in zip(held, sums):
                    total[ranks] += more
        if current is not None:
            yield settled(current, held)

    shares = map_batches(pairs.select("entries", "n", "note"), "bucket int, " + ", ".join(f"{c} binary" for c in kinds), parts)
    together = shares.repartition("bucket").sortWithinPartitions("bucket")
    return map_batches(together, "bucket int, entries binary, scale binary, backoff binary", weigh)


def higher_order(weights: DataFrame, lower: Lower, factor: np.ndarray) -> Higher:
    """From the table of :func:`histories`, of which its last bucket, of two histories at most, is collected."""
    bits: dict[int, tuple[float, float]] = {}
    for row in weights.where(F.col("bucket") == len(lower.starts) - 1).collect():
        scale, backoff = (spread_out(row[c], np.float64).tolist() for c in ("scale", "backoff"))
        bits |= dict(zip(climbed(row["entries"]).tolist(), zip(scale, backoff)))
    return Higher(factor, bits.get(0, (0.0, 0.0)), bits.get(1, (0.0, 0.0)))


def _before(values: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    before = np.append(start, values[:-1])
    before[np.append(0, np.cumsum(sizes)[:-1])] = start
    return before


def _cell(batch: pa.RecordBatch, i: int, name: str) -> object:
    return batch.column(batch.schema.get_field_index(name))[i].as_py()


def _chunk(batch: pa.RecordBatch, i: int, lower: Lower) -> tuple[np.ndarray, ...]:
    """Sizes of the texts and codes of their tokens; training counts and ids by code."""
    sizes, codes = spread_out(_cell(batch, i, "sizes"), np.int32), spread_out(_cell(batch, i, "codes"), np.int32)
    cell = _cell(batch, i, "words")
    counts, ids = _answered(cell, "n"), []
    for reply in cell:
        ranks = spread_out(reply["note"], np.int64)
        ids.append(np.where(ranks >= 0, lower.starts[reply["bucket"]] + ranks, lower.rare))
    ids = np.concatenate(ids)
    return sizes, codes, counts, np.where(counts > 0, ids, lower.rare)


def ask_pairs(chunks: DataFrame, lower: Lower, bits: int) -> DataFrame:
    """A row per chunk and bucket that asks for the chunk's distinct pairs, in order.

    A pair's note is the training count of its second word, 0 for the class of rare words.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(lower)
    names = ["chunk", "bucket", "entries", "counts", "notes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, codes, known, by_code = _chunk(batch, i, lower)
                ids, trains = by_code[codes], spread_out(_cell(batch, i, "trains"), np.uint8)
                keys = _before(ids, sizes, lower.start) * lower.width + ids
                pairs, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                counts = np.bincount(inverse, np.repeat(trains, sizes), len(pairs)).astype(np.int64)
                notes = np.where(by_code == lower.rare, 0, known)[codes[first]]
                order, buckets = _pair_order(pairs, bits)
                pairs, counts, notes = pairs[order], counts[order], notes[order]
                chunk = _cell(batch, i, "chunk")
                out = [
                    (chunk, b, squeezed_steps(pairs[s]), squeezed(counts[s]), squeezed(notes[s])) for b, s in _by_bucket(buckets)
                ]
                kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return map_batches(chunks, "chunk long, bucket int, entries binary, counts binary, notes binary", work)


def _score_chunks(chunks: DataFrame, lower: Lower, higher: Higher, bits: int) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast((lower, higher))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, higher = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                sizes, codes, known, by_code = _chunk(batch, i, lower)
                rare, ids = by_code == lower.rare, by_code[codes]
                pairs, inverse = np.unique(_before(ids, sizes, lower.start) * lower.width + ids, return_inverse=True)
                pair_counts = np.empty(len(pairs), np.int64)
                pair_counts[_pair_order(pairs, bits)[0]] = _answered(_cell(batch, i, "pairs"), "n")
                n, before = pair_counts[inverse], _before(codes, sizes, len(by_code))
                cell = _cell(batch, i, "histories")
                scale, backoff = (
                    np.append(np.where(rare, a, _answered(cell, c, np.float64)), b)
                    for c, a, b in zip(("scale", "backoff"), higher.rare, higher.start)
                )
                backoff = np.where(scale > 0, backoff, 1.0)
                chance = lower.chance(known)
                of_id = np.where(rare, lower.others, chance)
                with np.errstate(divide="ignore", invalid="ignore"):
                    logs = np.log10(np.where(n > 0, discounted(n, higher.factor) * scale[before], backoff[before] * of_id[codes]))
                logs += np.log10(chance / of_id)[codes]
                starts = np.append(0, np.cumsum(sizes)[:-1])
                counts = known[codes]
                columns = [
                    sizes.astype(np.int64),
                    np.add.reduceat((counts > 0).astype(np.int64), starts),
                    np.add.reduceat(lower.base(counts), starts),
                    np.add.reduceat(logs, starts),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_cell(batch, i, "keys"), pa.int64()), *map(pa.array, columns)],
                    names=["key", "n_tokens", "n_known", "base_score", "score"],
                )

    return map_batches(chunks, "key long, n_tokens long, n_known long, base_score double, score double", work)


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: float = VOCABULARY) -> DataFrame:
    """One row per input row: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the lower-cased (A-Z) words between blanks and one end per text. Learned from the rows outside the held-out
    fold. Null and empty texts are the end alone; repeated rows are scored, and counted, one by one; without training rows
    every score is 0; an empty table gives an empty result. Words are told apart by 64-bit hashes.
    """
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), text_of(f"`{text}`").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BUCKET_BITS, max(3, (size // BUCKET_BYTES).bit_length()))
    held = fold(F.col("key"), FOLDS) == HELD_OUT
    everything = stage(coded(source.select("key", (~held).alias("train"), "text"), bits), "coded")
    asked = everything.where(F.col("bucket").isNotNull()).select("chunk", "bucket", "entries", "counts")
    tokens = everything.agg(F.sum("train_tokens")).first()[0] or 0

    least = least_count(tokens, vocabulary)
    words, replies = counted(asked, "word-counts", least)
    lower = lower_order(words, tokens, least, bits)
    texts = everything.where(F.col("codes").isNotNull()).select("chunk", "keys", "sizes", "trains", "codes")
    texts = texts.join(by_chunk(replies, "words"), "chunk")

    pairs, pair_replies = counted(ask_pairs(texts, lower, bits), "pair-counts")
    factor = discounts(_counts_of_counts(pairs))
    weights = stage(histories(pairs, lower, factor), "histories")
    higher = higher_order(weights, lower, factor)
    ranks = replies.select("chunk", "bucket", F.col("note").alias("entries"))
    full = texts.join(by_chunk(pair_replies, "pairs"), "chunk")
    full = full.join(by_chunk(answers(ranks, weights, "scale", "backoff", read=_ranks), "histories"), "chunk")
    return _score_chunks(full, lower, higher, bits).select(
        F.col("key").alias(key),
        (fold(F.col("key"), FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
