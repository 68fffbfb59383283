"""Row identity, text columns and Arrow helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayloom.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java regular expressions of the separators between words.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def text_of(column: str | Column) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def folded(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; plain ASCII rows take the fast built-in."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, separators: str) -> Column:
    """The non-empty pieces between separators, as an array."""
    return F.filter(F.split(text, separators), lambda w: w != "")


def boxed(df: DataFrame, carry: Sequence[str] | None = None, **more: Column) -> DataFrame:
    """Every row (or its ``carry`` columns) as one struct ``row`` beside ``more``: no name in ``df`` can clash with them."""
    kept = F.struct(*[F.col(f"`{c}`") for c in (df.columns if carry is None else carry)])
    return df.select(kept.alias("row"), *[c.alias(n) for n, c in more.items()])


def row_ids(column: str | None) -> list[Column]:
    """The given column of row numbers as ``rid``, or nothing."""
    return [F.col(f"`{column}`").cast("long").alias("rid")] if column else []


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once with its row numbers ``rid``; new ones, if it has none, that no recomputation can change."""
    return stage(df if "rid" in df.columns else df.withColumn("rid", F.monotonically_increasing_id()), label)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Rows with texts that a task handles together.
TEXT_ROWS = 256


def map_batches(
    df: DataFrame,
    schema: StructType | str,
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    rows: int | None = None,
) -> DataFrame:
    """``mapInArrow``, with batches of at most ``rows`` rows; a task gives its unused memory back when it ends."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(batch.num_rows, 1)):
                yield batch.slice(at, rows)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(parts(batches))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(sliced, schema)


def boxed_texts(df: DataFrame, text: str, carry: Sequence[str] | None) -> DataFrame:
    """``row`` and, unless the row has it already, ``text``; so no text crosses to Python twice."""
    if text in (df.columns if carry is None else carry) and dict(df.dtypes)[text] == "string":
        return boxed(df, carry)
    return boxed(df, carry, text=text_of(f"`{text}`"))


def texts_in(batch: pa.RecordBatch, text: str) -> list[str]:
    """The texts of a batch of :func:`boxed_texts`, nulls as empty ones."""
    own = batch.schema.get_field_index("text")
    if own >= 0:
        return batch.column(own).to_pylist()
    return [t or "" for t in batch.column(batch.schema.get_field_index("row")).field(text).to_pylist()]


def whole(batch: pa.RecordBatch, name: str) -> list:
    """A column as Python values, nulls as they are."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def cells(values: Sequence[Sequence], kinds: Sequence[pa.DataType], names: Sequence[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=list(names))
