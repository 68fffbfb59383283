import re

import pytest

from assayloom.llm import licences
from assayloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts):
    """All matches by trying every template at every place."""
    known = licences.entries()
    vocabulary = {w for e in known for w in e.words}
    own = [words(t) for t in texts]
    frequencies = {w: sum(w in set(o) for o in own) for w in vocabulary}
    idf = licences.rarity(len(texts), frequencies, sorted(vocabulary))
    out = []
    for found in own:
        matches = []
        for entry in known:
            total = sum(idf[w] for w in entry.words)
            key = entry.words[entry.key_start : entry.key_start + entry.key_length]
            for first in [i for i, w in enumerate(found) if w == key[0]]:
                start = first - entry.key_start
                if tuple(found[first : first + len(key)]) != key:
                    continue
                share = sum(
                    idf[w] for i, w in enumerate(entry.words) if 0 <= start + i < len(found) and found[start + i] == w
                )
                if share / total >= licences.LEAST_SHARE:
                    matches.append((start, entry.label, entry.base, round(share / total, 6)))
        out.append((len(found), sorted(matches)))
    return out


def rows_of(scanned):
    return [
        (r["n_words"], [(m["start"], m["label"], m["base"], round(m["share"], 6)) for m in r["matches"]]) for r in scanned
    ]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    wanted = {d["doc_id"]: b for d, b in zip(docs, brute([d["text"] for d in docs]))}
    rows = QUERIES["op1_licences"](spark, folder).collect()
    assert len(rows) == len(docs) and any(r["n_base"] for r in rows)
    for r in rows:
        n_words, matches = wanted[r["doc_id"]]
        base = [m[0] for m in matches if m[2]]
        assert (r["n_words"], r["n_base"]) == (n_words, len(base))
        assert (r["first_word"], r["last_word"]) == ((min(base), max(base)) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({m[1] for m in matches if m[2]}))
        assert r["labels"] == ",".join(sorted({m[1] for m in matches}))
        assert r["score"] == pytest.approx(max((m[3] for m in matches), default=0.0))


def test_odd_rows(spark, odd, none):
    more = spark.createDataFrame(
        [
            (20, "MIT License, mit license! GNU\nGeneral-Public   License version 3"),
            (21, "public license version 2.0 under the Apache"),
            (22, "apache license, version 2.0"),
            (23, "Lizenziert under CC BY-NC 4.0"),
            (24, "license " * 20_000 + "mit license"),
            (24, "mit " * 20_000 + "license mit license"),
            (25, "x permission is hereby granted free of charge to any person obtaining a copy of the software and associated documentation files"),
        ],
        "doc_id long, text string",
    )
    docs = odd.select("doc_id", "text").unionByName(more)
    rows = licences.scan_licences(docs).collect()
    wanted = brute([r["row"]["text"] for r in rows])
    assert rows_of(rows) == wanted
    labels = {r["row"]["doc_id"]: {m["label"] for m in r["matches"]} for r in rows}
    assert labels[20] == {"mit", "gpl", "gpl-3.0"} and "cc-by-nc-4.0" in labels[23] and labels[25] == {"mit"}
    assert licences.digest(licences.scan_licences(none)).count() == 0
    assert licences.scan_licences(odd).select("row.*").columns == odd.columns
