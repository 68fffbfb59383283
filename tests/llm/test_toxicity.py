import math

from assayloom.llm import toxicity
from assayloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def said(text):
    return [m for m, _ in toxicity.Grammar(toxicity.lexicon_of(), frozenset(), toxicity.np.zeros(9), 0.0).matches(text)]


def test_clauses():
    assert said("What an IDIOT, really.") == ["insult"]
    assert said("You are an idiot") == ["directed_insult"]
    assert said("idiot! You are fine") == ["insult"]
    assert said("stupid, that is what you are") == ["directed_insult"]
    assert said("he is not an idiot") == ["negated_insult"]
    assert said("not a word of it was true, idiot") == ["insult"]
    assert said("they called her a moron") == ["reported_insult"]
    assert said("I will kill you. Kill the light.") == ["directed_threat", "threat"]
    assert said("the trash and the scum") == ["insult", "insult"]
    assert said("idiotic loserly") == [] and said("") == []


def test_product_follows_its_parts():
    parts = [toxicity.counter("negation", 3, "negated"), toxicity.latch("report", "reported"), toxicity.latch("target", "directed")]
    rng = toxicity.np.random.default_rng(1)
    for _ in range(200):
        state, states = 0, [0, 0, 0]
        for symbol in rng.integers(0, len(toxicity.SYMBOLS), 12).tolist():
            assert toxicity.GRAMMAR.mark[state] == frozenset().union(*(p.mark[s] for p, s in zip(parts, states)))
            state = toxicity.GRAMMAR.step[state][symbol]
            states = [p.step[s][symbol] for p, s in zip(parts, states)]


def test_words_are_learned_from_distinct_texts_only():
    toxic = [f"w{i} gribbel w{i + 1} v{i}" for i in range(30)]
    clean = [f"w{i} fine w{i + 1} v{i}" for i in range(60)]
    copies = ["some copied text with zork"] * 50
    assert toxicity.learned_words(toxic + copies + clean, [1] * 80 + [0] * 60) == (["gribbel"], frozenset())


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    found = [a for a, b in judged if b == 1]
    assert found.count(1) / len(found) > 0.95
    assert found.count(1) / [a for a, _ in judged].count(1) > 0.7


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1), (4, 7), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd, labels)
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in rows)
    assert len({r["score"] for r in rows if r["row"]["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.score_toxicity(none, model).count() == 0
    prior = toxicity.fit_toxicity(odd, labels.limit(0))
    more = spark.createDataFrame([(1, "x " * 50_000 + "you idiot"), (2, "plain")], "doc_id long, text string")
    scores = {r["row"]["doc_id"]: r["score"] for r in toxicity.score_toxicity(more, prior).collect()}
    assert scores[1] > 0.5 > scores[2]
