import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from assayloom.llm import packing
from assayloom.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokenizer_path())


def is_power(n):
    return n & (n - 1) == 0


def check(rows, wanted, key=lambda r: r["doc_id"]):
    """Every id once, offsets without gaps, every sequence full or a power of two."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(key(r), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == set(wanted)
    for doc, found in pieces.items():
        ids, at = np.array(wanted[doc] + [0], np.uint32), 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and is_power(at) and at == found[0]["tier"]


@pytest.mark.parametrize(
    "text",
    ["", " ", "  ", "a  b", "a   b", "a\n b", "a \nb", "a\n \nb", " a", "a ", "a  \n  b c", "don't  we'll x  y", "é日本 12 3 !! ?\t\t x  "],
)
def test_cut_texts_have_the_ids_of_whole_texts(tokenizer, text):
    assert packing.encoder(tokenizer_path()).encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_query_round_trip(spark, tokenizer):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    wanted = {d["doc_id"]: tokenizer.encode(d["text"], add_special_tokens=False).ids for d in docs}
    check(QUERIES["op9_packing"](spark, folder).collect(), wanted)


def test_odd_rows(odd, none, tokenizer):
    numbered = odd.selectExpr("monotonically_increasing_id() AS doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in numbered.collect()}
    packed = packing.pack(numbered, tokenizer_path()).selectExpr("row.doc_id AS doc_id", "*")
    rows = packed.collect()
    check(rows, {k: tokenizer.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()})
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_longest_windows_take_shorter_pieces():
    pool = packing.Pool()
    for doc, length in enumerate((900, 124, 500, 12, 60, 60, 8)):
        pool.put(doc, 0, length)
    windows = list(packing.pack_tiers(pool, (128, 256, 512, 1024)))
    assert windows[0] == (1024, [(0, 0, 900), (1, 0, 124)])
    assert windows[1] == (512, [(2, 0, 500), (3, 0, 12)])
    assert windows[2][0] == 128 and sum(p[2] for p in windows[2][1]) == 128


def test_step_groups_hold_equal_tokens(spark):
    rows = packing.pack(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer_path(), ids=False, step_tokens=4096
    ).collect()
    tokens = {}
    for r in rows:
        tokens[r["tier"], r["step_group"]] = tokens.get((r["tier"], r["step_group"]), 0) + r["length"]
    full = [n for (tier, _), n in tokens.items() if n == 4096]
    assert len(full) >= len(tokens) - 11
