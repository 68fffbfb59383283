"""Licence scans by a positional rare-token index.

The index holds, for every template, the positions of its rarest words, by inverse document frequency over the whole corpus.
A document looks up only those words. A word at place p of the document that stands at offset o of a template says that the
template may start at p - o; the other words of the template are then compared at their own relative places, and the match
counts if they carry enough of the template's weight and its mandatory key phrase stands there word for word.

Everything is column expressions inside one row: no shuffle but the word counts, whose size is that of the template vocabulary.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.rows import NOT_WORD, boxed, folded, text_of, words_of

#: Share of a template's weight that has to match.
LEAST_SHARE = 0.8

# Base phrases and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Label, template and the key phrase that has to stand in it word for word.
TEMPLATES = (
    ("agpl", "gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        "redistribution and use in source and binary forms",
    ),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3"),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "permission to use copy modify and or distribute this software",
    ),
    ("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files",
        "permission is hereby granted free of charge",
    ),
    (
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "mozilla public license v 2 0",
    ),
    ("proprietary", "all rights reserved", "all rights reserved"),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain",
        "released into the public domain",
    ),
)


@dataclass(frozen=True)
class Entry:
    """A template or base phrase: its label, words, and where its key phrase stands."""

    label: str
    words: tuple[str, ...]
    key_start: int
    key_length: int
    base: bool


def entries(
    base: Sequence[tuple[str, str]] = BASE_PHRASES, templates: Sequence[tuple[str, str, str]] = TEMPLATES
) -> list[Entry]:
    out = [Entry(label, tuple(p.split()), 0, len(p.split()), True) for p, label in base]
    for label, template, key in templates:
        words, part = template.split(), key.split()
        start = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
        out.append(Entry(label, tuple(words), start, len(part), False))
    return out


def document_frequencies(words: DataFrame, vocabulary: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Rows, and rows with each word; ``words`` has an array column ``words``."""
    own = F.array_distinct(F.filter("words", lambda w: w.isin(*vocabulary)))
    counted = words.select(F.explode_outer(F.array_union(own, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counted.collect()}
    return found.pop("", 0), found


def rarity(rows: int, frequencies: Mapping[str, int], vocabulary: Sequence[str]) -> dict[str, float]:
    return {w: 1 + math.log((rows + 1) / (frequencies.get(w, 0) + 1)) for w in vocabulary}


def index_of(known: Sequence[Entry], idf: Mapping[str, float]) -> list[tuple[str, int, int]]:
    """Postings (word, entry, offset) of each entry's rarest words.

    One word for a base phrase, which matches as a whole. For a template as many as carry more weight than a match may miss,
    so every match has one of them in its place.
    """
    out = []
    for number, entry in enumerate(known):
        total, held = sum(idf[w] for w in entry.words), 0.0
        for word in sorted(set(entry.words), key=lambda w: (-idf[w], w)):
            places = [i for i, w in enumerate(entry.words) if w == word]
            out += [(word, number, i) for i in places]
            held += idf[word] * len(places) / total
            if entry.base or held > 1 - LEAST_SHARE + 1e-6:
                break
    return out


def _table(known: Sequence[Entry], idf: Mapping[str, float]) -> Column:
    rows = []
    for entry in known:
        total = sum(idf[w] for w in entry.words)
        rows.append(
            F.struct(
                F.lit(entry.label).alias("label"),
                F.array(*[F.lit(w) for w in entry.words]).alias("words"),
                F.array(*[F.lit(idf[w] / total) for w in entry.words]).alias("shares"),
                F.lit(entry.key_start).alias("key_start"),
                F.array(*[F.lit(w) for w in entry.words[entry.key_start : entry.key_start + entry.key_length]]).alias("key"),
                F.lit(entry.base).alias("base"),
            )
        )
    return F.array(*rows)


def _found(words: Column, known: Sequence[Entry], idf: Mapping[str, float], postings: Sequence[tuple]) -> Column:
    """``array<struct<label, base, start, share>>`` of everything that matches."""
    table = _table(known, idf)
    index = F.array(
        *[F.struct(F.lit(w).alias("word"), F.lit(n).alias("entry"), F.lit(o).alias("offset")) for w, n, o in postings]
    )
    rare = sorted({w for w, _, _ in postings})
    # An entry at a start is one number, so that removing repeats stays linear.
    code = lambda start, entry: (start + most) * len(known) + entry
    most = max(len(e.words) for e in known)
    places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.get(words, i).isin(*rare))
    starts = F.flatten(
        F.transform(
            places,
            lambda i: F.transform(
                F.filter(index, lambda p: p["word"] == F.get(words, i)),
                lambda p: code(i - p["offset"], p["entry"]),
            ),
        )
    )

    def judged(at: Column) -> Column:
        entry = F.element_at(table, at % len(known) + 1)
        start = F.floor(at / len(known)).cast("int") - most
        here = lambda i: F.get(words, start + i)
        share = F.aggregate(
            F.sequence(F.lit(0), F.size(entry["words"]) - 1),
            F.lit(0.0),
            lambda sum_, i: sum_ + F.when(here(i) == F.get(entry["words"], i), F.get(entry["shares"], i)).otherwise(0.0),
        )
        first = start + entry["key_start"]
        key = F.when(first >= 0, F.slice(words, first + 1, F.size(entry["key"])) == entry["key"]).otherwise(False)
        return F.struct(
            entry["label"].alias("label"), entry["base"].alias("base"), start.alias("start"), share.alias("share"), key.alias("key")
        )

    return F.filter(F.transform(F.array_distinct(starts), judged), lambda m: m["key"] & (m["share"] >= LEAST_SHARE - 1e-9))


def scan_licences(
    docs: DataFrame,
    text: str = "text",
    base: Sequence[tuple[str, str]] = BASE_PHRASES,
    templates: Sequence[tuple[str, str, str]] = TEMPLATES,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``row`` (the input row, or its ``carry`` columns), n_words, matches (label, base, start in words, share), sorted by start.

    A base phrase matches where all its words stand in a row, a template where its key phrase does and enough of its weight.
    Null and empty texts have no words and no matches; repeated rows are scanned one by one; an empty table gives an empty
    result. Places are words from 0; a template's start can be negative when the text begins inside it.
    """
    known = entries(base, templates)
    vocabulary = sorted({w for e in known for w in e.words})
    held = boxed(docs, carry, text=folded(text_of(f"`{text}`"))).select("row", words_of(F.col("text"), NOT_WORD).alias("words"))
    rows, frequencies = document_frequencies(held.select("words"), vocabulary)
    idf = rarity(rows, frequencies, vocabulary)
    postings = index_of(known, idf)
    found = _found(F.col("words"), known, idf, postings)
    key = lambda m: F.struct(m["start"], m["label"], m["base"], m["share"])
    sorted_matches = F.array_sort(F.transform(found, key))
    return held.select("row", F.size("words").cast("long").alias("n_words"), sorted_matches.alias("matches"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, first and last place and labels of :func:`scan_licences`."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"].cast("long"))
    names = lambda found: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))))
    return scanned.select(
        "row",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)), 6).alias("score"),
    )
