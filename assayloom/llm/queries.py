"""The registered queries of this subpackage: one per operator, over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm import (
    conversations,
    decontamination,
    exact,
    katz,
    licences,
    packing,
    pii,
    quality,
    sharding,
    simhash,
    spelling,
    toxicity,
    winnowing,
)
from assayloom.llm.rows import folded, text_of


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts."""
    marked = exact.mark_duplicates(_read(spark, folder, "documents"))
    return marked.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document inside benchmark windows."""
    docs, benchmark = _read(spark, folder, "documents"), _read(spark, folder, "benchmark")
    found = decontamination.find_contamination(docs, benchmark, carry=["doc_id"])
    found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["words"]))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def op1_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    scanned = licences.digest(licences.scan_licences(_read(spark, folder, "documents"), carry=["doc_id"]))
    return scanned.select(F.col("row.doc_id").alias("doc_id"), *scanned.columns[1:])


def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and its component of near duplicates."""
    return simhash.near_duplicates(_read(spark, folder, "documents")).drop("rid", "kept")


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.find_personal_data(_read(spark, folder, "documents"), carry=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]],
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _read(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, _read(spark, folder, "labels"))
    scored = toxicity.score_toxicity(docs, model, carry=["doc_id"])
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        toxicity.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("clauses").cast("long").alias("n_clauses"),
    )


def op6_katz(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document."""
    return katz.score_texts(_read(spark, folder, "documents"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    docs = _read(spark, folder, "documents")
    model = quality.fit_quality(docs, _read(spark, folder, "labels"))
    scored = quality.score_quality(docs, model, carry=["doc_id"])
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        quality.held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        quality.accepted().cast("int").alias("predicted"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a packed sequence."""
    packed = packing.pack(_read(spark, folder, "documents"), tokenizer_path(), ids=False)
    return packed.select(F.col("row.doc_id").alias("doc_id"), *packed.columns[1:])


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its shard and its slot there."""
    dealt = sharding.shuffle_into_shards(_read(spark, folder, "documents"))
    text = F.coalesce("row.text", F.lit(""))
    return dealt.select(
        "row.doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose second half is the beginning of the next document."""
    found = winnowing.winnow_with_next(_read(spark, folder, "documents"), carry=["doc_id"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    found = found.withColumn("edited", edited)
    found = found.withColumn("edited_fingerprint", winnowing.fingerprint(F.col("edited")))
    own, changed = F.col("fingerprint"), F.col("edited_fingerprint")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.written(own).alias("fingerprint"),
        winnowing.written(changed).alias("edited_fingerprint"),
        winnowing.likeness(own, changed).alias("near_edited"),
        winnowing.likeness(own, F.col("next_fingerprint")).alias("near_next"),
    )


#: Code points that a word has at least, and how often it has to occur.
_LEAST_LETTERS, _LEAST_COUNT, _MISSPELT = 7, 2, 31


def misspelt_words(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of whole texts, one in 31 occurrences without one of its letters, as their id and spelling decide.

    Null texts have no words; a null id counts as an empty one.
    """
    letters = F.lit(r"[A-Za-z\u00C0-\u00FF]{" + f"{_LEAST_LETTERS},}}")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(text_of("text"), letters, F.lit(0))).alias("run"))
    runs = runs.select("doc_id", folded(F.col("run")).alias("run"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run")
    hashed = runs.select("run", F.crc32(key.cast("binary")).alias("hash"))
    place = (F.col("hash") % F.length("run")).cast("int")
    shorter = F.concat(F.left("run", place), F.substring("run", place + 2, F.length("run")))
    words = hashed.select(F.when(F.col("hash") % _MISSPELT == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= _LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= _LEAST_COUNT)


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Every word with the more frequent word that it is a variant of."""
    return spelling.group_variants(misspelt_words(_read(spark, folder, "documents")))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Rows with faults, as a checksum of conversation and turn decides: dropped, emptied, unpunctuated, repeated, another role."""
    written = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(written("text"), ".!?", "")).otherwise(written("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    role = F.when(kind == 4, "user").otherwise(written("role"))
    damaged = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), copies)
    return damaged.drop("col")


def op13_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Every damaged conversation with its faults and its repair."""
    turns = damaged_turns(_read(spark, folder, "conversations"))
    return conversations.repair_conversations(turns, present="present").withColumnRenamed("conversation", "conv_id")


QUERIES = {
    "op1_licences": op1_licences,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_personal_data": op4_personal_data,
    "op5_toxicity": op5_toxicity,
    "op6_katz": op6_katz,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_winnowing": op11_winnowing,
    "op12_spelling": op12_spelling,
    "op13_conversations": op13_conversations,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = (
    "list_filter(string_split_regex(" + _FOLD + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)

ORACLE = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS size,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain
            FROM documents
        ), r AS (
            SELECT doc_id, plain, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size
            FROM d WINDOW w AS (PARTITION BY plain ORDER BY size DESC, doc_id)
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM r
    """,
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
        i AS (
            SELECT DISTINCT item, least(len(w), 13) AS width,
                   array_to_string(w[unnest(range(1, greatest(len(w) - 12, 1) + 1)):][1:13], ' ') AS win
            FROM b WHERE len(w) > 0
        ),
        widths AS (SELECT DISTINCT width FROM i),
        p AS (
            SELECT doc_id, width, place, array_to_string(w[place:place + width - 1], ' ') AS win
            FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS place FROM d, widths WHERE len(w) >= width)
        ),
        h AS (SELECT doc_id, p.place, p.width, item FROM p JOIN i ON p.win = i.win AND p.width = i.width),
        hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit
                FROM (SELECT doc_id, unnest(range(place, place + width)) AS x FROM h) GROUP BY doc_id),
        own AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
                FROM h GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
    """,
}
