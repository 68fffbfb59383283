"""Vocabulary built from the data, and token ids looked up in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.text import RESERVED_IDS, UNKNOWN_ID, token_places, tokens, truncated
from assayloom.operators.ordered import running
from assayloom.operators.spread import HOT_ROWS, hot_keys, spread_join
from assayloom.staging import stage


def build_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """``token, uses, token_id`` over all tokens of all whole texts, the most used first, ties by token.

    Ids start above the reserved ones (padding, unknown). The texts are read once; the staged counts are ordered.
    """
    used = df.select(F.explode(tokens(F.col(text))).alias("token"))
    counted = stage(used.groupBy("token").agg(F.count(F.lit(1)).alias("uses")), "token-counts")
    one = F.lit(1).cast("long")
    outputs = {"_rank": ("sum", "_one")}
    ranked = running(counted.withColumn("_one", one), [], ["-uses", "token"], outputs)
    return ranked.select("token", "uses", (F.col("_rank") + (RESERVED_IDS - 1)).cast("int").alias("token_id"))


def encode_tokens(
    df: DataFrame,
    key: str,
    text: str,
    vocabulary: DataFrame,
    length: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``key, ids``: vocabulary ids of all tokens of each whole text; tokens it lacks get the unknown id.

    ``length`` cuts texts for a model whose window ends there. Each text sends its different tokens, with their places, once; the
    lookup is a join with frequent tokens spread (Spark decides by size whether it broadcasts), and ids and places, no text, are
    brought together again. ``key`` is unique.
    """
    window = tokens(F.col(text)) if length is None else truncated(tokens(F.col(text)), length)
    # A text without tokens keeps one row without places; its stand-in token holds a space, so it is no word.
    placed = df.select(key, F.explode_outer(token_places(window)).alias("_token"))
    token = F.coalesce("_token.token", F.lit(" ")).alias("token")
    placed = stage(placed.select(key, token, F.col("_token.places").alias("_places")), "token-places")
    ids = vocabulary.select("token", "token_id")
    found = spread_join(placed, ids, ["token"], [key], hot_keys(placed, ["token"], hot_rows), "left")
    id_ = F.coalesce("token_id", F.lit(UNKNOWN_ID))
    pairs = F.transform("_places", lambda p: F.struct(p.alias("place"), id_.alias("id")))
    gathered = F.array_sort(F.flatten(F.collect_list(pairs)))
    return found.groupBy(key).agg(F.transform(gathered, lambda p: p["id"]).alias("ids"))
