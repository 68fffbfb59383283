"""Training text from raw documents: quality, exact and near duplicates, benchmark passages, packing.

Every stage works on all that its predecessor kept and takes its decisions on whole texts. What it drops is gone; what it keeps
has the columns of ``documents`` unchanged. Null texts count as empty, repeated rows as copies of each other, an empty table
passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm import decontamination, exact, packing, quality, simhash
from assayloom.llm.queries import tokenizer_path
from assayloom.llm.rows import boxed, numbered
from assayloom.sources.tables import table
from assayloom.staging import stage


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality machine, fitted on the labels, does not reject."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where(quality.accepted()).select("row.*")


def _without(held: DataFrame, dropped: DataFrame) -> DataFrame:
    return held.join(dropped, "rid", "left_anti").select("row.*")


def _with_numbers(docs: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows, numbered and written once, and what the duplicate operators read of them."""
    held = numbered(boxed(docs), label)
    return held, held.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    held, read = _with_numbers(docs, "pipeline-exact")
    return _without(held, exact.mark_duplicates(read, rid="rid").where(~F.col("kept")).select("rid"))


def different_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    held, read = _with_numbers(docs, "pipeline-near")
    return _without(held, simhash.near_duplicates(read, rid="rid").where(~F.col("kept")).select("rid"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    found = decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    clean: Column = ~decontamination.contaminated()
    return found.where(clean).select("row.*")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences, with their ids."""
    packed = packing.pack(docs, tokenizer_path())
    return packed.select(F.col("row.doc_id").alias("doc_id"), *packed.columns[1:])


STAGES = [
    ("quality", good_documents),
    ("exact duplicates", distinct_documents),
    ("near duplicates", different_documents),
    ("decontamination", clean_documents),
    ("packing", packed_sequences),
]

#: SQL cannot express the fitted machine, the fingerprints' hash or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
