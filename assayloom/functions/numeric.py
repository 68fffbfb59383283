"""Numeric expressions: lossy coercion, log-scale target, threshold label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The log transform of a nanomolar concentration and the label threshold.
LOG_OFFSET = 9
LOG_EPSILON = 1e-10
LABEL_THRESHOLD = 5.0

# Plain or scientific decimal notation; leaves out type suffixes, thousands separators, bounds, inf and NaN.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number(text: Column) -> Column:
    """Text as a double, null where it is not a plain number. Infinity is not accepted."""
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(NUMBER_PATTERN), trimmed).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def finite(value: Column) -> Column:
    """The value, null where it is NaN or infinite: the one rule of what counts as a value in metrics and curves."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def negative_log_molar(nanomolar: Column) -> Column:
    """``9 - log10(v + 1e-10)`` to 6 decimals; null for negative values.

    Without the rounding the epsilon would push the boundary value 10,000 just below 5 and so flip its label.
    """
    return F.round(F.lit(LOG_OFFSET) - F.log10(nanomolar + F.lit(LOG_EPSILON)), 6)


def threshold_label(value: Column, threshold: float = LABEL_THRESHOLD) -> Column:
    """1 at or above the threshold, else 0."""
    return (value >= F.lit(threshold)).cast("int")
