"""Vector expressions and their MLlib forms."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def first_position(hidden: Column) -> Column:
    """The vector at the first position of a sequence of vectors; null for an empty sequence."""
    return F.try_element_at(hidden, F.lit(1))


def as_feature_vector(features: Column) -> Column:
    """A float array as the vector type that estimators take."""
    return array_to_vector(features.cast("array<double>"))


def has_length(features: Column, length: int) -> Column:
    """True for a present vector of the given length."""
    return features.isNotNull() & (F.size(features) == length)


def positive_probability(probability: Column) -> Column:
    """The second entry of a two-class probability vector."""
    return vector_to_array(probability)[1]


def flat(nested: Column) -> Column:
    return F.flatten(nested)


def as_column_shape(features: Column) -> Column:
    """Every entry as its own one-entry array."""
    return F.transform(features, lambda v: F.array(v))
