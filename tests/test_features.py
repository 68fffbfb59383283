"""Token windows, fingerprints, vocabulary ids and vector shapes."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assayloom.functions import text as T
from assayloom.functions import vectors as V
from assayloom.operators.vocabulary import build_vocabulary, encode_tokens
from assayloom.plans import queries_features as Q


@pytest.mark.parametrize("count", [0, 1, 511, 512, 513])
def test_window(spark, count):
    frame = spark.createDataFrame([(list(range(7, 7 + count)),)], "ids array<int>")
    row = frame.select(T.padded(F.col("ids")).alias("p"), T.attention_mask(F.col("ids")).alias("m")).first()
    kept = min(count, 512)
    assert row["p"] == list(range(7, 7 + kept)) + [0] * (512 - kept)
    assert row["m"] == [1] * kept + [0] * (512 - kept)


def bits(words):
    runs = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return sorted({int(hashlib.md5(r.encode()).hexdigest()[:8], 16) % 2048 for r in runs})


def test_fingerprint(spark):
    texts = ["", "one", "One two", "a b c d a b c d", "\tx \n y  z "]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    words = T.tokens(F.col("t"))
    rows = frame.select("t", T.fingerprint(words).alias("b"), T.usable_fingerprint(words, 2).alias("u")).collect()
    for r in rows:
        expected = bits(r["t"].lower().split())
        assert r["b"] == expected
        assert r["u"] == (expected if len(r["t"].split()) >= 2 else None)


def test_text_fingerprint_is_that_of_the_tokens(spark):
    texts = [None, "", " \t\n", "One", "a b\x0bc\x0cd\re\x1cf\x85g\xa0h\u2003i", "  ÉCOLE İ ΣΑΣ  日本語 a", "x y " * 500, "\ud7ff \U0001f600 z"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    words = T.tokens(F.col("t"))
    few = T.text_fingerprint(F.col("t"), least_tokens=3).alias("few")
    wide = T.text_fingerprint(F.col("t"), 1 << 20).alias("wide")
    rows = frame.select("t", words.alias("words"), T.fingerprint(words).alias("b"), T.text_fingerprint(F.col("t")).alias("x"), few, wide).collect()
    for r in rows:
        expected = None if r["t"] is None else bits(r["words"])
        assert r["b"] == r["x"] == expected
        assert r["few"] == (expected if r["words"] and len(r["words"]) >= 3 else None)
        assert (r["wide"] is None) == (r["t"] is None) and sorted({v % 2048 for v in r["wide"] or []}) == (expected or [])


def test_groups_of_rows_do_not_change_fingerprints(monkeypatch):
    import pyarrow as pa

    draw = random.Random(4)
    rows = [None if i % 7 == 3 else [f"w{draw.randrange(30)}" for _ in range(draw.randrange(9))] for i in range(60)]
    for size in (1, 5, 1000):
        monkeypatch.setattr(T, "TOKENS_AT_ONCE", size)
        found = T._fingerprints(pa.array(rows, pa.list_(pa.string())).slice(2), 2048, 3, 2).to_pylist()
        assert found == [bits(r) if r is not None and len(r) > 1 else None for r in rows[2:]]


def test_a_usable_fingerprint_is_computed_once(spark, small):
    """Neither the filter nor the size computes it again."""
    plan = Q.usable_fingerprints(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(text") == 1 and "md5(" not in plan


@pytest.mark.parametrize("hot_rows", [1000, 20])
def test_vocabulary_and_ids(spark, hot_rows):
    draw = random.Random(2)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 12)))) for i in range(80)] + [(99, "zzz the")]
    frame = spark.createDataFrame(texts, "id int, t string").repartition(4)
    known = frame.where("id < 99")
    vocabulary = build_vocabulary(known, "t")
    counts = Counter(w for i, t in texts if i < 99 for w in t.split())
    expected = {w: k + 2 for k, (w, _) in enumerate(sorted(counts.items(), key=lambda c: (-c[1], c[0])))}
    assert {r["token"]: r["token_id"] for r in vocabulary.collect()} == expected
    encoded = encode_tokens(frame, "id", "t", vocabulary, 8, hot_rows)
    assert {r["id"]: r["ids"] for r in encoded.collect()} == {
        i: [expected.get(w, 1) for w in t.split()[:8]] for i, t in texts
    }


def test_vector_shapes(spark):
    frame = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([],)], "h array<array<float>>")
    rows = frame.select(V.first_position(F.col("h")).alias("f"), V.flat(F.col("h")).alias("a")).collect()
    assert [r["f"] for r in rows] == [[1.0, 2.0], None]
    assert rows[0]["a"] == [1.0, 2.0, 3.0, 4.0]
    vector = frame.limit(1).select(V.as_feature_vector(V.flat(F.col("h"))).alias("v")).first()["v"]
    assert list(vector.toArray()) == [1.0, 2.0, 3.0, 4.0]
