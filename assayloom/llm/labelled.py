"""Labelled rows for fitting: a fixed fold of them, at most a stated number, chosen by a hash of their id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(key: Column, folds: int) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


#: Bytes of text that all chosen rows may have together.
MOST_TRAINING_BYTES = 256 << 20


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held_out: int,
    most: int,
    key: str = "doc_id",
    text: str = "text",
    most_bytes: int = MOST_TRAINING_BYTES,
) -> DataFrame:
    """``key, text, label`` of up to ``most`` labelled documents outside the held-out fold, of up to ``most_bytes`` of text in all.

    Labels other than 0 and 1 and null ids are left out; of several labels of one id the larger counts, of several texts of one id
    the one of least digest, so there is one row per id. The chosen labels are at most ``most`` small rows, so they are broadcast
    and the documents are not shuffled; repeats of an id meet in partial aggregates, before anything is exchanged.
    """
    known = labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("key"), folds) != held_out))
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most)
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    met = source.join(F.broadcast(chosen), "key")
    single = met.groupBy("key", "label").agg(F.min_by("text", F.sha2("text", 256)).alias("text"))
    # At most ``most`` rows: one task adds up their sizes in the order in which they were chosen.
    upto = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("key"), "key"))
    return single.withColumn("_upto", upto).where(F.col("_upto") <= most_bytes).select("key", "text", "label")
