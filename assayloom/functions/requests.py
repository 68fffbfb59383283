"""Request and response expressions for scoring: type check, per-row errors, nested answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the response.
SUCCESS = "success"
FAILURE = "error"
HIGH_RISK = "High risk of hERG liability"
LOW_RISK = "Appears safe"


def required_string(body: Column, field: str) -> Column:
    """The field of a JSON body if it is there and is a JSON string, else null. The empty string is accepted."""
    parsed = F.try_parse_json(body)
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(parsed, f"$.{field}", "string"))


def request_error(body: Column, field: str) -> Column:
    """Why a body is rejected: ``not json``, ``missing field``, ``wrong type``, or null for a good one."""
    parsed = F.try_parse_json(body)
    value = F.try_variant_get(parsed, f"$.{field}", "variant")
    return (
        F.when(parsed.isNull(), "not json")
        .when(value.isNull(), "missing field")
        .when(F.schema_of_variant(value) != "STRING", "wrong type")
    )


def risk_text(is_toxic: Column) -> Column:
    return F.when(is_toxic, F.lit(HIGH_RISK)).otherwise(F.lit(LOW_RISK))


def response(
    text: Column, is_toxic: Column, probability: Column, predicted: Column, error: Column, text_name: str = "smiles"
) -> Column:
    """The nested answer for one row: both results of a good one, or the reason why there is none."""
    good = error.isNull()
    return F.struct(
        text.alias(text_name),
        F.when(good, F.struct(
            is_toxic.alias("is_toxic"),
            F.round(probability, 4).alias("confidence_score"),
            risk_text(is_toxic).alias("warning"),
        )).alias("classification"),
        F.when(good, F.struct(F.round(predicted, 4).alias("predicted_pIC50"))).alias("regression"),
        F.when(good, SUCCESS).otherwise(FAILURE).alias("status"),
        error.alias("error"),
    )
