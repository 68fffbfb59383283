"""Batched vector encoding of token windows with a pluggable encoder.

An encoder factory runs once per Python worker and returns ``f(input_ids, attention_mask) -> vectors`` over NumPy
batches, which is the shape of a frozen neural encoder. The default one needs no download: every token id owns a fixed
random direction, and a text is the mean direction of its tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from assayloom.functions.text import MAX_TOKENS, hashed_ids, tokens, truncated

Encoder = Callable[[np.ndarray, np.ndarray], np.ndarray]
TABLE_SIZE = 4096
BATCH_ROWS = 32


def _mean_direction(directions: np.ndarray) -> Encoder:
    def encode(input_ids: np.ndarray, attention_mask: np.ndarray) -> np.ndarray:
        kept = attention_mask.astype(np.float32)
        total = np.einsum("rt,rtd->rd", kept, directions[input_ids])
        return total / np.maximum(kept.sum(axis=1, keepdims=True), 1)

    return encode


def mean_direction_encoder(dimensions: int = 64, table_size: int = TABLE_SIZE, seed: int = 42) -> Callable[[], Encoder]:
    """Factory of the default encoder."""

    def make() -> Encoder:
        return _mean_direction(np.random.default_rng(seed).standard_normal((table_size, dimensions)).astype(np.float32))

    return make


def hashed_direction_encoder(dimensions: int = 4, table_size: int = TABLE_SIZE) -> Callable[[], Encoder]:
    """Factory of a small encoder of whole-numbered directions, from -8 to 7: the leading hex digits of the id's MD5.

    Other engines can compute it too.
    """

    def make() -> Encoder:
        digits = [[int(d, 16) for d in hashlib.md5(str(i).encode()).hexdigest()[:dimensions]] for i in range(table_size)]
        return _mean_direction(np.array(digits, np.float32) - 8)

    return make


def encode_windows(
    df: DataFrame, make_encoder: Callable[[], Encoder], length: int = MAX_TOKENS, batch_rows: int = BATCH_ROWS
) -> DataFrame:
    """Add ``features`` from the ``input_ids`` and ``attention_mask`` columns, both padded to ``length``."""
    encode = predict_batch_udf(
        make_encoder,
        return_type=ArrayType(FloatType()),
        batch_size=batch_rows,
        input_tensor_shapes=[[length], [length]],
    )
    return df.withColumn("features", encode("input_ids", "attention_mask"))


def whole_text_vectors(make_encoder: Callable[[], Encoder], window: int, batch_rows: int) -> Callable[[Column], Column]:
    """Vectors of id arrays of any length: consecutive windows, encoded in batches, as the mean weighted by their tokens."""

    @F.pandas_udf(ArrayType(FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            rows = [np.empty(0, np.int64) if ids is None else np.asarray(ids) for ids in batch]
            parts = [(i, ids[at : at + window]) for i, ids in enumerate(rows) for at in range(0, max(len(ids), 1), window)]
            total, weight = None, np.zeros(len(rows))
            for at in range(0, len(parts), batch_rows):
                chosen = parts[at : at + batch_rows]
                ids, mask = np.zeros((len(chosen), window), np.int64), np.zeros((len(chosen), window), np.int64)
                for place, (_, part) in enumerate(chosen):
                    ids[place, : len(part)], mask[place, : len(part)] = part, 1
                vectors, tokens_ = encoder(ids, mask), mask.sum(axis=1)
                total = np.zeros((len(rows), vectors.shape[1])) if total is None else total
                owners = [i for i, _ in chosen]
                np.add.at(total, owners, vectors * tokens_[:, None])
                np.add.at(weight, owners, tokens_)
            means = [] if total is None else list((total / np.maximum(weight, 1)[:, None]).astype(np.float32))
            yield pd.Series(means, dtype=object)

    return encode


def encode_texts(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Encoder] | None = None,
    length: int | None = None,
    table_size: int = TABLE_SIZE,
    batch_rows: int = BATCH_ROWS,
    window: int = MAX_TOKENS,
) -> DataFrame:
    """Tokenise whole texts with hashed ids and add the ``features`` vector; a null text has no tokens.

    Encoders see windows of ``window`` tokens; a longer text is the mean of its windows, weighted by their tokens. ``length``
    cuts texts instead, for a model that ends there.
    """
    make = make_encoder or mean_direction_encoder(table_size=table_size)
    ids = tokens(F.col(text)) if length is None else truncated(tokens(F.col(text)), length)
    encode = whole_text_vectors(make, length or window, batch_rows)
    return df.withColumn("features", encode(hashed_ids(ids, table_size)))
