"""Benchmark passages in documents, found by one Aho-Corasick automaton in a single pass over each text.

The automaton holds every window of ``width`` consecutive words of the normalised questions and answers, each between
blanks, so that only whole words match. Matches are mapped to word numbers and, for spans, to code points of the original.

The benchmark is the query set: it is cut into blocks of at most ``BLOCK_WINDOWS`` windows, and each block is scanned against
all documents with one automaton. A block is what the driver and every worker hold, whatever the size of the benchmark.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from assayloom.llm.rows import NOT_WORD, TEXT_ROWS, boxed_texts, folded, map_batches, text_of, texts_in, whole, words_of

WINDOW_WORDS = 13
#: Windows in one automaton: about 100 MB in a worker.
BLOCK_WINDOWS = 200_000

_NOT_WORD = re.compile(NOT_WORD)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = {ord("A") + i: ord("a") + i for i in range(26)}
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW_WORDS) -> DataFrame:
    """Distinct (window, item) rows; an item of fewer words, but not none, is one window."""
    words = words_of(folded(text_of(f"`{text}`")), NOT_WORD)
    last = F.greatest(F.size("words") - width, F.lit(0))
    parted = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.slice("words", i + 1, width)))
    return parted.select("item", F.explode(windows).alias("window")).distinct()


def padded_words(text: str) -> str:
    """Normalised words, each between single blanks: ``" w1 w2 "``; empty without words."""
    lowered = text.lower() if text.isascii() else text.translate(_FOLD)
    return f" {_NOT_WORD.sub(' ', lowered).strip(' ')} "


def _automaton(name: str, windows: list[tuple[str, list[str]]]) -> ahocorasick.Automaton:
    if name not in _AUTOMATA:
        _AUTOMATA.clear()
        built = ahocorasick.Automaton()
        for window, items in windows:
            built.add_word(f" {window} ", (window.count(" ") + 1, items))
        if len(built):
            built.make_automaton()
        _AUTOMATA[name] = built
    return _AUTOMATA[name]


def matches(automaton: ahocorasick.Automaton, words: str) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges ``[from, to)`` of window occurrences, and the items with one."""
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    blanks: list[int] = []
    for end, (length, owners) in automaton.iter(words):
        if not blanks:
            blanks = [i for i, c in enumerate(words) if c == " "]
        upto = bisect_left(blanks, end)
        ranges.append((upto - length, upto))
        items.update(owners)
    return ranges, items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """The ranges as code points of the original text, with their number of words."""
    if not ranges:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    return [{"start": places[a][0], "stop": places[b - 1][1], "words": b - a} for a, b in ranges]


_RANGES = pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())]))


def merged_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(stop, merged[-1][1])
        else:
            merged.append((start, stop))
    return merged


def scan_block(
    docs: DataFrame, text: str, windows: list[tuple[str, list[str]]], name: str, last: bool, spans: bool
) -> DataFrame:
    """``docs`` (row, text and what earlier blocks found) with this block's matches; after the last one, the result."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    first = "ranges" not in docs.columns
    row = StructType().add(docs.schema["row"])
    if last:
        span = StructType().add("start", LongType()).add("stop", LongType()).add("words", LongType())
        schema = row.add("n_words", LongType()).add("n_hit", LongType())
        schema = schema.add("items", ArrayType(StringType())).add("spans", ArrayType(span))
    else:
        range_ = StructType().add("first", IntegerType()).add("stop", IntegerType())
        schema = row.add("text", StringType()) if "text" in docs.columns else row
        schema = schema.add("ranges", ArrayType(range_)).add("items", ArrayType(StringType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, shared.value)
        for batch in batches:
            n_words, all_ranges, all_items = [], [], []
            texts = texts_in(batch, text)
            before = [([], [])] * len(texts) if first else zip(whole(batch, "ranges"), whole(batch, "items"))
            for own, (old_ranges, old_items) in zip(texts, before):
                words = padded_words(own)
                n_words.append(words.count(" ") - 1 if len(words) > 2 else 0)
                found, owners = matches(automaton, words) if len(automaton) else ([], set())
                all_ranges.append(merged_ranges([(r["first"], r["stop"]) for r in old_ranges] + found))
                all_items.append(sorted(owners.union(old_items)))
            box = batch.column(batch.schema.get_field_index("row"))
            items = pa.array(all_items, pa.list_(pa.string()))
            if last:
                hits = pa.array([sum(b - a for a, b in r) for r in all_ranges], pa.int64())
                places = [original_spans(t, r) if spans else [] for t, r in zip(texts, all_ranges)]
                arrays = [box, pa.array(n_words, pa.int64()), hits, items, pa.array(places, _SPANS)]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_words", "n_hit", "items", "spans"])
            else:
                ranges = pa.array([[{"first": a, "stop": b} for a, b in r] for r in all_ranges], _RANGES)
                text_at = batch.schema.get_field_index("text")
                kept = [box, batch.column(text_at)] if text_at >= 0 else [box]
                yield pa.RecordBatch.from_arrays([*kept, ranges, items], names=schema.names)

    return map_batches(docs, schema, work, TEXT_ROWS)


def blocks_of(windows: DataFrame, most: int = BLOCK_WINDOWS) -> list[DataFrame]:
    """The windows with their items in blocks of about ``most`` windows."""
    parts = max(1, -(-windows.count() // most))
    part = F.pmod(F.xxhash64("window"), F.lit(parts))
    return [windows.where(part == i).groupBy("window").agg(F.collect_set("item").alias("items")) for i in range(parts)]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WINDOW_WORDS,
    most_windows: int = BLOCK_WINDOWS,
    carry: Sequence[str] | None = None,
    spans: bool = True,
) -> DataFrame:
    """``row`` (the input row, or its ``carry`` columns), ``n_words``, ``n_hit``, ``items`` (sorted), ``spans`` of the original
    (start, stop, words).

    Null and empty texts have no words; null or wordless items have no window; an empty benchmark matches nothing; an empty
    table gives an empty result; repeated rows are judged one by one. A word covered by several occurrences counts once.
    """
    found = boxed_texts(docs, text, carry)
    blocks = blocks_of(benchmark_windows(benchmark, item, item_text, width), most_windows)
    for number, block in enumerate(blocks):
        windows = [(r["window"], sorted(r["items"])) for r in block.collect()]
        digest = hashlib.sha256(repr(windows).encode()).hexdigest()
        found = scan_block(found, text, windows, digest, number == len(blocks) - 1, spans)
    return found


def contaminated() -> Column:
    """The rule: some word is hit, and at least one word in twenty."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
