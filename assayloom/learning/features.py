"""Feature vectors for trees."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.text import FINGERPRINT_BITS, text_fingerprint


def with_fingerprint_vector(
    df: DataFrame, text: str, vector: str = "vector", bits: int = FINGERPRINT_BITS, least_tokens: int = 1
) -> DataFrame:
    """Add the fingerprint as a sparse 0/1 vector; rows with too few tokens are left out, with their labels."""
    positions = text_fingerprint(F.col(text), bits, least_tokens=least_tokens).cast("array<string>")
    described = df.withColumn("_positions", positions).where(F.col("_positions").isNotNull())
    one_each = CountVectorizerModel.from_vocabulary([str(i) for i in range(bits)], "_positions", vector, binary=True)
    return one_each.transform(described).drop("_positions")
