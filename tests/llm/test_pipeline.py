import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from assayloom.llm import quality
from assayloom.llm.queries import tokenizer_path
from tests.llm.test_decontamination import brute
from tests.llm.test_packing import check
from tests.llm.test_simhash import plain_components, plain_fingerprint

FOLDER = "/root/testdata/sf0.001"


def kept_texts(texts, scores, items):
    """The stages by plain Python, from the quality scores on."""
    texts = {k: t for k, t in texts.items() if scores[k] >= quality.THRESHOLD}
    groups = {}
    for key in sorted(texts, key=lambda k: (-len(texts[k]), k)):
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", "", texts[key]), key)
    texts = {k: texts[k] for k in groups.values()}
    roots = plain_components({k: plain_fingerprint(t) for k, t in texts.items()})
    texts = {k: t for k, t in texts.items() if roots[k] == k}
    out = {}
    for key, text in texts.items():
        n_words, n_hit, _ = brute(text, items)
        if not (n_hit and 20 * n_hit >= n_words):
            out[key] = text
    return out


def test_rows_equal_brute_force(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    texts = {r["doc_id"]: r["text"] for r in read("documents").collect()}
    model = quality.fit_quality(read("documents"), read("labels"))
    scores = {r["row"]["doc_id"]: r["score"] for r in quality.score_quality(read("documents"), model, carry=["doc_id"]).collect()}
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    wanted = kept_texts(texts, scores, items)
    assert 0 < len(wanted) < len(texts)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    check(rows, {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in wanted.items()})


@pytest.mark.parametrize("name,step", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_of_documents(spark, odd, none, name, step):
    for docs in (odd, none):
        out = step(spark, docs, FOLDER)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert out.exceptAll(docs).count() == 0
    if name == "exact duplicates":
        assert step(spark, odd, FOLDER).count() == 9
    if name == "near duplicates":
        texts = [r["text"] for r in step(spark, odd, FOLDER).collect()]
        assert len({plain_fingerprint(t) for t in texts}) == len(texts)


def test_last_stage_takes_odd_rows(spark, odd, none):
    step = corpus_pipeline.STAGES[-1][1]
    assert {r["doc_id"] for r in step(spark, odd, FOLDER).collect()} == {r["doc_id"] for r in odd.collect()}
    assert step(spark, none, FOLDER).count() == 0
