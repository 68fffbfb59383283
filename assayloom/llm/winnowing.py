"""Document fingerprints by winnowing.

A text is a row of tokens: runs without blanks, cut after every ``TOKEN`` code points, so that texts without blanks have tokens
too. Every run of k tokens is a gram; its hash is rolled up from the token hashes by doubling (two tokens, four, k), so a gram
costs the logarithm of k and not k. Of every window of w neighbouring grams the one with the smallest hash is kept, of several
smallest the rightmost, with its place. Neighbouring windows mostly keep the same gram, so about 2 / (w + 1) of all grams stay.

Two texts that share k + w - 1 tokens in a row share a window and so at least one kept gram, with its place in both. A gram shorter
than k tokens is kept only when it is the whole text.

Everything is column expressions inside one row. The smallest hash of a window is found by doubling too, on one number per
gram that holds 31 bits of its hash above its place counted backwards; the whole hash is looked up for kept grams only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.llm.rows import boxed, numbered, text_of

#: Tokens of a gram, grams of a window, code points of a token.
GRAM, WINDOW, TOKEN = 5, 4, 16
_PLACES = 0x7FFFFFFF


def _bound(value: Column, work: Callable[[Column], Column]) -> Column:
    """``work(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), work), 1)


def _pairs(left: Column, right: Column, shift: int, work: Callable[[Column, Column], Column]) -> Column:
    """``work(left[i], right[i + shift])`` for every i that both have."""
    size = F.least(F.size(left), F.size(right) - shift)
    return F.zip_with(F.slice(left, 1, size), F.slice(right, shift + 1, size), work)


def _rolled(units: Column, width: int, work: Callable[[Column, Column], Column], overlap: bool) -> Column:
    """``work`` over every ``width`` neighbours of an array of at least that size, by doubling.

    With ``overlap`` (for a minimum) the last step may count a neighbour twice; without it (for a hash) the rest is added in
    runs of halving length.
    """

    def grown(held: Column, have: int) -> Column:
        if have == width:
            return held
        if 2 * have <= width:
            return _bound(_pairs(held, held, have, work), lambda next_: grown(next_, 2 * have))
        if overlap:
            return _pairs(held, held, width - have, work)
        rest = _rolled(units, width - have, work, False)
        return _pairs(held, rest, have, work)

    return grown(units, 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1," + str(TOKEN) + "}"), F.lit(0))


def _grams(words: Column, gram: int) -> Column:
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    join = lambda a, b: F.xxhash64(a, b)
    return _bound(
        hashed,
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>"))
        .when(F.size(h) < gram, F.array(F.xxhash64(h)))
        .otherwise(_rolled(h, gram, join, False)),
    )


def _kept(grams: Column, window: int) -> Column:
    order = F.transform(
        grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 33), 32).bitwiseOR(F.lit(_PLACES).bitwiseXOR(i))
    )
    lowest = lambda codes: F.array_distinct(_rolled(codes, window, lambda a, b: F.least(a, b), True))
    return _bound(
        order,
        lambda codes: F.when(F.size(codes) == 0, codes)
        .when(F.size(codes) <= window, F.array(F.array_min(codes)))
        .otherwise(lowest(codes)),
    )


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """``array<struct<hash: bigint, place: int>>``: the kept grams of a text by place (the gram's first token, from 0).

    Null and empty texts, and texts of blanks only, have none. Equal texts have equal fingerprints.
    """

    def looked_up(grams: Column) -> Column:
        def entry(code: Column) -> Column:
            place = code.bitwiseAND(F.lit(_PLACES).cast("bigint")).cast("int").bitwiseXOR(F.lit(_PLACES))
            return F.struct(F.get(grams, place).alias("hash"), place.alias("place"))

        return F.transform(_kept(grams, window), entry)

    return _bound(_grams(tokens(text_of(text)), gram), looked_up)


def written(prints: Column) -> Column:
    """A fingerprint as text: ``hash@place``, the hash as 16 hex digits, comma-joined."""
    one = lambda p: F.concat(F.lpad(F.lower(F.hex(p["hash"])), 16, "0"), F.lit("@"), p["place"])
    return F.array_join(F.transform(prints, one), ",")


def likeness(left: Column, right: Column) -> Column:
    """Share of two fingerprints' different hashes that both have; 1 if neither has any, 0 if one has none."""
    both, either = F.size(F.array_intersect(left["hash"], right["hash"])), F.size(F.array_union(left["hash"], right["hash"]))
    return F.when(either == 0, 1.0).otherwise(F.round(both / F.greatest(either, F.lit(1)), 6))


def winnow(
    df: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW, carry: Sequence[str] | None = None
) -> DataFrame:
    """``row`` (the input row, or its ``carry`` columns) and ``fingerprint``; see :func:`fingerprint`.

    Repeated rows are fingerprinted one by one, an empty table gives an empty result.
    """
    held = boxed(df, carry, text=text_of(f"`{text}`"))
    return held.select("row", fingerprint(F.col("text"), gram, window).alias("fingerprint"))


def _chunk_of(point: Column, heads: Column, chunks: int) -> Column:
    """The last chunk whose head isn't above ``point``, by binary search."""
    steps = F.sequence(F.lit(1), F.lit(max(chunks - 1, 1).bit_length()))

    def halve(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["low"] + span["high"] + 1, 1)
        above = F.get(heads, middle) > point
        return F.struct(
            F.when(above, span["low"]).otherwise(middle).alias("low"),
            F.when(above, middle - 1).otherwise(span["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(chunks - 1).alias("high"))
    return F.aggregate(steps, start, halve, lambda span: span["low"])


def winnow_with_next(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    gram: int = GRAM,
    window: int = WINDOW,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``row, text, fingerprint, next_text, next_fingerprint``: every text with the one that follows by ascending ``key``.

    Null keys come first, rows of one key follow in their written order, and the first row follows the last; a single row follows
    itself. Null texts are empty ones. Rows go once to chunks of neighbouring keys, whose bounds are rows themselves (one
    per task on the driver); the first row of a chunk is copied to the end of the chunk before. A key that holds any share of the
    rows is split like others.
    """
    more = {"key": F.col(f"`{key}`"), "text": text_of(f"`{text}`")}
    table = numbered(boxed(df, carry, **more), "to-winnow")
    point = F.struct("key", "rid")
    chunks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table.select("key", "rid").repartitionByRange(chunks, "key", "rid")
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.min(point).alias("head"))
    written_heads = firsts.select(F.to_json("head", {"ignoreNullFields": "false"}).alias("json"), "head").orderBy("head")
    found = [r["json"] for r in written_heads.select("json").collect()]
    kind = f"array<{firsts.schema['head'].dataType.simpleString()}>"
    heads = F.from_json(F.lit(json.dumps([json.loads(h) for h in found])), kind)
    chunk = _chunk_of(point, heads, max(len(found), 1))
    placed = table.withColumn("chunk", chunk)
    own = F.struct("chunk", F.lit(0).alias("again"), F.lit(False).alias("guard"))
    first = F.col("chunk") == 0
    copy = F.struct(
        F.when(first, max(len(found) - 1, 0)).otherwise(F.col("chunk") - 1).alias("chunk"),
        first.cast("int").alias("again"),
        F.lit(True).alias("guard"),
    )
    is_head = F.get(heads, F.col("chunk")) == point
    places = F.explode(F.when(is_head, F.array(own, copy)).otherwise(F.array(own))).alias("at")
    dealt = placed.select("row", "key", "rid", "text", places).select("row", "key", "rid", "text", "at.*")
    dealt = dealt.repartitionById(max(len(found), 1), "chunk")
    prints = dealt.withColumn("fingerprint", fingerprint(F.col("text"), gram, window))
    following = Window.partitionBy("chunk").orderBy("again", "key", "rid")
    led = prints.withColumns({f"next_{c}": F.lead(c).over(following) for c in ("text", "fingerprint")})
    return led.where(~F.col("guard")).select("row", "text", "fingerprint", "next_text", "next_fingerprint")
