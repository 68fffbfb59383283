"""Curation of measurement tables: shape, coerce, normalise, collapse, transform, label, split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.functions.numeric import LABEL_THRESHOLD, negative_log_molar, threshold_label, to_number
from assayloom.functions.text import canonical_key
from assayloom.operators.collapse import collapse_duplicates
from assayloom.operators.split import group_split, split_sizes
from assayloom.sinks.files import write_csv
from assayloom.sources.files import RAW_SCHEMA, read_csv
from assayloom.sources.tables import filtered_scan
from assayloom.staging import stage


def keep_complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without null (or NaN) in the given columns."""
    return df.na.drop(subset=list(columns))


def clean_measurements(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with a key and a numeric value; the value may arrive as text."""
    complete = keep_complete(df, [key, value])
    return keep_complete(complete.withColumn(value, to_number(F.col(value).cast("string"))), [value])


def with_canonical_key(df: DataFrame, text: str, key: str) -> DataFrame:
    """Add the canonical key and drop rows that have none.

    Only text without any visible character has none. Asking for one is cheap; a filter on the key would compute it twice.
    """
    return df.where(F.col(text).rlike(r"\S")).withColumn(key, canonical_key(F.col(text)))


def keyed_by_digest(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """``key_digest`` and the kept columns, staged: long texts are read once and never shuffled.

    The digest is SHA-256 of the canonical key, so equal digests mean equal keys.
    """
    keyed = with_canonical_key(df, text, "_canonical")
    return stage(keyed.select(F.sha2("_canonical", 256).alias("key_digest"), *keep), "digests")


def curate(df: DataFrame, keys: Sequence[str], value: str, first: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Collapse to one row per key and add the log target ``y``."""
    collapsed = collapse_duplicates(df, keys, value, first, order)
    return collapsed.withColumn("y", negative_log_molar(F.col(f"median_{value}")))


def with_label(df: DataFrame, threshold: float = LABEL_THRESHOLD) -> DataFrame:
    return df.withColumn("label", threshold_label(F.col("y"), threshold))


def fetch(source: DataFrame, equals: Mapping[str, Any], path: str) -> None:
    """Select records at the source, keep complete ones with a numeric value, and write them as the raw CSV."""
    columns = [field.split()[0] for field in RAW_SCHEMA.split(", ")]
    raw = filtered_scan(source, equals, columns)
    write_csv(clean_measurements(raw, "canonical_smiles", "standard_value"), path)


def process_and_split(
    spark: SparkSession, raw_path: str, path: str, groups: DataFrame, group: str, key: str = "canonical_smiles"
) -> DataFrame:
    """The raw CSV as curated CSV rows ``id, smiles, pIC50`` in one folder per split; returns the rows per split.

    ``groups`` maps the canonical key to its group; keys that it lacks form a group of their own.
    """
    raw = read_csv(spark, raw_path, RAW_SCHEMA)
    cleaned = with_canonical_key(clean_measurements(raw, key, "standard_value"), key, "canonical")
    order = ["molecule_chembl_id", "standard_value"]
    narrow = stage(cleaned.select("canonical", *order), "cleaned")
    curated = curate(narrow, ["canonical"], "standard_value", ["molecule_chembl_id"], order)
    known = groups.select(F.col(key).alias("canonical"), F.col(group).alias("_group"))
    grouped = curated.join(known, "canonical", "left").withColumn("_group", F.coalesce("_group", "canonical"))
    split = group_split(stage(grouped, "curated"), "_group", ["canonical"])
    named = split.select(
        F.col("first_molecule_chembl_id").alias("id"), F.col("canonical").alias("smiles"), F.col("y").alias("pIC50"), "split"
    )
    written = stage(named, "split")
    write_csv(written, path, ["split"])
    return split_sizes(written)


def curate_and_split(
    df: DataFrame, text: str, value: str, identifier: str, group: str, order: Sequence[str]
) -> DataFrame:
    """Raw records to ``key, median, first identifier, y, group, split`` in one go.

    ``group`` is a column of the raw records that is equal for rows of one canonical key, such as a scaffold.
    """
    cleaned = with_canonical_key(clean_measurements(df, text, value), text, "canonical")
    first = [identifier, group] if identifier != group else [identifier]
    cleaned = stage(cleaned.select("canonical", value, *dict.fromkeys([*first, *order])), "cleaned")
    curated = stage(curate(cleaned, ["canonical"], value, first, order), "curated")
    return group_split(curated, f"first_{group}", ["canonical"])
