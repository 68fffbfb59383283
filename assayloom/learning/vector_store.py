"""Vectors kept by the content of their texts, so that each text is encoded once.

The store is a Parquet table of SHA-256 digests and vectors, one folder per encoder version and one per run below it. A run looks up the
digests of its texts and sends only the unknown ones to the encoder, one text per digest; copies, and texts of earlier runs, get
their vector by a join. A new encoder has a new version and never meets vectors of an old one. A run's folder appears when the run's job
is committed, so a run that fails leaves nothing; two runs at once may both encode a text, and readers take one of the equal vectors.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.learning.encoding import Encoder, encode_texts
from assayloom.operators.spread import HOT_ROWS, hot_keys, spread_join
from assayloom.staging import stage

_SCHEMA = "digest string, features array<float>"
_DIGEST = "_digest"


def text_digest(text: Column) -> Column:
    """A null text counts as empty: neither has tokens."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def stored_vectors(spark: SparkSession, path: str, version: str) -> DataFrame:
    """``digest, features`` of one encoder version, each digest once."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", version):
        raise ValueError(f"a version has letters, digits, dots, dashes and underscores, not {version!r}")
    try:
        rows = spark.read.schema(_SCHEMA).parquet(f"{path}/{version}/*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)
    return rows.groupBy("digest").agg(F.any_value("features").alias("features"))


def add_unknown(
    df: DataFrame, text: str, path: str, version: str, make_encoder: Callable[[], Encoder] | None = None, **settings
) -> int:
    """Encode the texts that the store lacks and add their vectors; returns how many there were.

    Digests alone decide what is unknown; whole texts of unknown digests only are shuffled, one per digest and task.
    """
    spark = df.sparkSession
    texts = df.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("digest", text_digest(F.col("text")))
    known = stored_vectors(spark, path, version).select("digest")
    unknown = stage(texts.select("digest").distinct().join(known, "digest", "left_anti"), "unknown-digests")
    count = unknown.count()
    if count:
        wanted = texts.join(unknown, "digest", "left_semi").groupBy("digest").agg(F.any_value("text").alias("text"))
        encoded = encode_texts(wanted, "text", make_encoder, **settings).select("digest", "features")
        encoded.write.parquet(f"{path}/{version}/run={uuid.uuid4().hex}")
    return count


def encode_once(
    df: DataFrame,
    text: str,
    path: str,
    version: str,
    make_encoder: Callable[[], Encoder] | None = None,
    hot_rows: int = HOT_ROWS,
    **settings,
) -> DataFrame:
    """``df`` with ``features``, equal to encoding every row; texts that any run has encoded before are looked up.

    A text that a large share of the rows hold is one digest; its rows are spread over several tasks. ``settings`` are those of
    :func:`encode_texts` and belong to the version.
    """
    add_unknown(df, text, path, version, make_encoder, **settings)
    rows = df.withColumn(_DIGEST, text_digest(F.col(f"`{text}`")))
    vectors = stored_vectors(df.sparkSession, path, version).withColumnRenamed("digest", _DIGEST)
    spread_by = [c for c in df.columns if c != text] or [text]
    return spread_join(rows, vectors, [_DIGEST], spread_by, hot_keys(rows, [_DIGEST], hot_rows)).drop(_DIGEST)
