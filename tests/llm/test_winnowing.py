import hashlib
import re

import pytest
from pyspark.sql import functions as F

from assayloom.llm import winnowing
from assayloom.llm.queries import QUERIES

TOKEN = re.compile(r"[^\x20\x09-\x0D]{1,16}")


def kept_places(hashes, window):
    """Every window's smallest hash, the rightmost of several."""
    if not hashes:
        return []
    order = [(h & (2**64 - 1)) >> 33 for h in hashes]
    out = set()
    for start in range(max(len(order) - window, 0) + 1):
        part = range(start, min(start + window, len(order)))
        out.add(min(part, key=lambda i: (order[i], -i)))
    return sorted(out)


def all_grams(spark, texts, gram, window=1):
    """Hash of each gram, from fingerprints that keep all (a window of one)."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    found = winnowing.winnow(rows, gram=gram, window=1).collect()
    return {r["row"]["i"]: [(p["hash"], p["place"]) for p in r["fingerprint"]] for r in found}


@pytest.mark.parametrize("gram,window", [(5, 4), (1, 1), (3, 7), (7, 2), (4, 8)])
def test_every_window_keeps_its_rightmost_smallest(spark, gram, window):
    texts = ["a b a b a b a b a b a b a b a b c", "x", "", " \t", "one two three", "q" * 400, "w " * 300, None]
    texts += [" ".join(f"t{(i * i + j) % 23}" for i in range(90)) for j in range(5)]
    grams = all_grams(spark, texts, gram)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in winnowing.winnow(rows, gram=gram, window=window).collect():
        words, mine = TOKEN.findall(r["row"]["text"] or ""), grams[r["row"]["i"]]
        assert [p for _, p in mine] == list(range(max(len(words) - gram, 0) + 1 if words else 0))
        shingles = [tuple(words[i : i + gram]) for i in range(len(mine))]
        assert len(set(shingles)) == len({h for h, _ in mine})
        wanted = [mine[i] for i in kept_places([h for h, _ in mine], window)]
        assert [(p["hash"], p["place"]) for p in r["fingerprint"]] == wanted


def test_a_shared_passage_shares_a_gram(spark):
    shared = " ".join(f"s{i}" for i in range(winnowing.GRAM + winnowing.WINDOW - 1))
    texts = [f"{'left ' * i}{shared} end{i}" for i in range(9)] + ["nothing of that is in here at all really not"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    prints = [{p["hash"] for p in r["fingerprint"]} for r in winnowing.winnow(rows).collect()]
    assert all(prints[0] & p for p in prints[:-1]) and not prints[0] & prints[-1]


def brute(docs):
    docs = sorted(docs, key=lambda d: d[0])
    out = {}
    for i, (key, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        out[key] = (text, text[: len(text) - half] + after[:half], after)
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    wanted = brute(docs)
    rows = QUERIES["op11_winnowing"](spark, folder).collect()
    assert len(rows) == len(docs)
    texts = sorted({t for three in wanted.values() for t in three})
    prints = dict(zip(texts, winnow_all(spark, texts)))
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in rows:
        text, edited, after = wanted[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == ",".join(f"{h & (2**64 - 1):016x}@{p}" for h, p in prints[text])
        assert r["edited_fingerprint"] == ",".join(f"{h & (2**64 - 1):016x}@{p}" for h, p in prints[edited])
        own, changed, next_ = ({h for h, _ in prints[t]} for t in (text, edited, after))
        assert r["near_edited"] == pytest.approx(alike(own, changed), abs=1e-6)
        assert r["near_next"] == pytest.approx(alike(own, next_), abs=1e-6)
    long = [r for r in rows if r["n_chars"] >= 400]
    assert sum(r["near_edited"] > 0.2 for r in long) > 0.95 * len(long)


def winnow_all(spark, texts):
    """Kept grams of each text by the plain rule, over hashes of all grams."""
    grams = all_grams(spark, texts, winnowing.GRAM)
    for i in range(len(texts)):
        yield [grams[i][at] for at in kept_places([h for h, _ in grams[i]], winnowing.WINDOW)]


def test_odd_rows(spark, odd, none):
    for parts in ("3", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        rows = winnowing.winnow_with_next(odd).collect()
        assert len(rows) == odd.count()
        order = sorted(rows, key=lambda r: (r["row"]["doc_id"] is not None, r["row"]["doc_id"] or 0))
        assert [r["text"] for r in order] == [r["row"]["text"] or "" for r in order]
        assert [r["next_text"] for r in order] == [r["text"] for r in order[1:] + order[:1]]
        assert [r["next_fingerprint"] for r in order] == [r["fingerprint"] for r in order[1:] + order[:1]]
        assert rows[0]["row"].asDict().keys() == {"doc_id", "text", "row", "rid"}
        single = winnowing.winnow_with_next(odd.where("doc_id = 8")).collect()
        assert [(r["text"], r["next_text"]) for r in single] == [("x", "x")]
        assert winnowing.winnow_with_next(none).count() == 0 and winnowing.winnow(none).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    one = winnowing.winnow(odd, carry=["doc_id"]).where("row.doc_id = 3").first()
    assert one["fingerprint"] == []


def test_a_key_with_most_rows_is_split(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    docs = spark.range(4000).select(
        F.when(F.col("id") % 10 < 7, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")
    )
    rows = winnowing.winnow_with_next(docs).select("text", "next_text", F.spark_partition_id().alias("part")).collect()
    assert len(rows) == 4000 and len({r["next_text"] for r in rows}) == 4000
    assert max(sum(r["part"] == p for r in rows) for p in range(8)) < 1200
