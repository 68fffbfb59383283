import math
import zlib
from collections import Counter
from functools import cached_property

import numpy as np
import pytest

from assayloom.llm import katz
from assayloom.llm.queries import QUERIES


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def factor_of(counts):
    n = Counter(counts.values())
    return katz.discounts([n[r] for r in range(1, katz.MOST_DISCOUNTED + 2)])


class Brute:
    """The model with dictionaries, word by word."""

    def __init__(self, docs, vocabulary):
        self.docs = [(k, [*(t or "").encode().lower().split(), b""]) for k, t in docs]
        train = [w for k, w in self.docs if not held(k)]
        self.c = Counter(x for w in train for x in w)
        self.total = sum(self.c.values())
        least = max(2, -(-self.total // vocabulary))
        self.frequent = {w for w, n in self.c.items() if n >= least}
        self.d1 = factor_of(self.c)
        self.pairs = Counter()
        for words in train:
            before = "start"
            for word in map(self.id, words):
                self.pairs[before, word] += 1
                before = word
        self.d2 = factor_of(self.pairs)
        self.by_history, self.known = {}, {}
        for (h, v), n in self.pairs.items():
            self.by_history.setdefault(h, {})[v] = n

    def id(self, word):
        return word if word in self.frequent else "rare"

    @cached_property
    def unknown(self):
        return sum(n * (1 - self.d1[n]) for n in self.c.values() if n <= katz.MOST_DISCOUNTED) / self.total

    @cached_property
    def rare(self):
        return 1 - sum(self.lower(w) for w in self.frequent)

    def lower(self, word):
        if not self.total:
            return 1.0
        n = self.c[word]
        return n * (self.d1[n] if n <= katz.MOST_DISCOUNTED else 1) / self.total if n else self.unknown

    def lower_id(self, v):
        return self.rare if v == "rare" else self.lower(v)

    def history(self, h):
        """Discounted shares of what was seen after ``h``, and its backoff weight."""
        if h not in self.known:
            seen = self.by_history[h]
            total = sum(seen.values())
            kept = {w: n * (self.d2[n] if n <= katz.MOST_DISCOUNTED else 1) / total for w, n in seen.items()}
            open_share = 1 - sum(self.lower_id(w) for w in seen)
            freed = 1 - sum(kept.values())
            if open_share <= 1e-9:
                freed, open_share = 0, 1
            elif freed <= 1e-9:
                freed = 1 / (total + 1)
            scale = (1 - freed) / sum(kept.values())
            self.known[h] = {w: k * scale for w, k in kept.items()}, freed / open_share
        return self.known[h]

    def higher(self, h, v):
        if h not in self.by_history:
            return self.lower_id(v)
        kept, backoff = self.history(h)
        return kept[v] if v in kept else backoff * self.lower_id(v)

    def word(self, h, word):
        v = self.id(word)
        return self.higher(h, v) * (self.lower(word) / self.lower_id("rare") if v == "rare" else 1)

    def score(self, words):
        out, before = 0.0, "start"
        for word in words:
            out += math.log10(self.word(before, word))
            before = self.id(word)
        return out


def check(rows, brute):
    wanted = {}
    for key, words in brute.docs:
        base = sum(math.log10((brute.c[w] + 0.1) / (brute.total + 0.1 * (len(brute.c) + 1))) for w in words)
        known = sum(brute.c[w] > 0 for w in words)
        wanted.setdefault((key, len(words), known), []).append((base, brute.score(words)))
    assert len(rows) == len(brute.docs)
    for r in rows:
        base, score = wanted[r["doc_id"], r["n_tokens"], r["n_known"]].pop()
        assert r["train_tokens"] == brute.total and r["held_out"] == held(r["doc_id"])
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(score, rel=1e-7, abs=1e-7)


@pytest.mark.parametrize("chunk", [500, 2_000_000])
def test_small_tables_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(katz, "CHUNK_TOKENS", chunk)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 60)) if x < 4000) for _ in range(300)]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for vocabulary in (50_000, 40, 4):
        brute = Brute(docs, vocabulary)
        check(katz.score_texts(frame, vocabulary=vocabulary).collect(), brute)
        ids = [*brute.frequent, "rare"]
        for h in [*ids[:20], "rare", "start"]:
            assert sum(brute.higher(h, v) for v in ids) == pytest.approx(1)
        unknown = sum(brute.lower(w) for w in brute.c) + brute.lower(b"never seen")
        assert unknown == pytest.approx(1)


def test_query_beats_the_base_on_held_out_texts(spark):
    rows = QUERIES["op6_katz"](spark, "/root/testdata/sf0.1").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(rows) == 10_000 and out
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    check(QUERIES["op6_katz"](spark, folder).collect(), Brute(docs, katz.VOCABULARY))


def test_odd_rows(odd, none, spark):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(katz.score_texts(odd).collect(), Brute(docs, katz.VOCABULARY))
    assert katz.score_texts(none).count() == 0
    only_held = next(k for k in range(1000) if held(k))
    rows = katz.score_texts(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).collect()
    assert [(r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in rows] == [(0.0, 0.0, 0, 0)]


def test_discounts():
    assert (katz.discounts([100, 40, 22, 14, 10, 7])[1:] < 1).all()
    assert (katz.discounts([0] * 6)[1:] > 0).all() and (katz.discounts([5, 0, 0, 0, 0, 0])[1:] < 1).all()


def test_words_seen_twice_have_pairs_in_a_large_table_too(spark):
    """Over 100,000 tokens the former cut, a share of 1 / 50,000, left words seen twice no pairs."""
    rng = np.random.default_rng(8)
    docs = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 450) % 30_000)) for k in range(300)]
    brute = Brute(docs, math.inf)
    assert brute.total > 110_000 and sum(n == 2 for n in brute.c.values()) > 1_000
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    check(katz.score_texts(frame).collect(), brute)
