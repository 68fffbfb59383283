import random
import re
import zlib

import pytest

from assayloom.llm import spelling
from assayloom.llm.queries import QUERIES, misspelt_words

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    """Every word against every word with which it shares its first or its second half, or all if there are few."""
    words = sorted(counts)
    if len(words) < 3000:
        others = {w: [v for v in words if near(w, v)] for w in words}
    else:
        halves = {}
        for w in words:
            for part in {(k, w[:k]) for k in range(len(w) // 2 - 1, len(w) // 2 + 2)} | {
                (-k, w[len(w) - k :]) for k in range(len(w) // 2 - 1, len(w) // 2 + 2)
            }:
                halves.setdefault(part, []).append(w)
        found = {w: set() for w in words}
        for group in halves.values():
            for i, a in enumerate(group):
                for b in group[i + 1 :]:
                    if near(a, b):
                        found[a].add(b)
                        found[b].add(a)
        others = {w: sorted(v) for w, v in found.items()}
    form = {}
    for w in words:
        best = min(others[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(others[w]), counts[form[w]] if form[w] is not None else None)
    return out


def grouped(spark, counts, ratio=10):
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r["word"]: tuple(r)[1:] for r in spelling.group_variants(rows, ratio).collect()}


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_random_words(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rng = random.Random(5)
    counts = {}
    for size in (1, 2, 3, 4, 6):
        for _ in range(250):
            counts["".join(rng.choice("abé") for _ in range(size))] = 10 ** rng.randrange(1, 7) + rng.randrange(2)
    counts[""], counts["z" * 20_000], counts["z" * 20_001], counts["😀bc"], counts["😀b"] = 3, 2, 40, 5, 500
    got = grouped(spark, counts)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == brute(counts)
    assert got["z" * 20_000][:2] == ("z" * 20_001, "z" * 20_001) and got["😀bc"][0] == "😀b"


def test_ranges_share_the_nodes_that_cross_their_border():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(300)} | {"a" * 30})
    for cut in (1, 2, 7, 50):
        ranges = [words[i : i + cut] for i in range(0, len(words), cut)]
        lasts = [r[-1] for r in ranges]
        known = {}
        for number, part in enumerate(ranges):
            state = spelling.Numbering(number, lasts[: number + 1])
            for word in part:
                _, nodes = state.add(word)
                assert len(nodes) == len(word) + 1
                for depth, node in enumerate(nodes):
                    assert known.setdefault(word[:depth], node) == node
        assert len(set(known.values())) == len(known)


def test_chains_ties_and_repeats(spark):
    counts = {"letters": 10, "lettres": 1, "lettersx": 1000, "lettersxy": 10**5, "abcdefg": 10, "abcdefh": 100, "abcdefi": 100}
    got = grouped(spark, counts)
    assert got["letters"] == ("lettersx", "lettersxy", 10, 1, 1000) and got["lettres"] == (None, "lettres", 1, 0, None)
    assert got["abcdefg"] == ("abcdefh", "abcdefh", 10, 2, 100)
    rows = spark.createDataFrame([("aaaa", 1, 1), ("aaaa", 1, 2), ("aaa", 20, 3), (None, 5, 4)], "word string, n long, id int")
    found = {r["word"]: tuple(r)[1:] for r in spelling.group_variants(rows).collect()}
    assert found == {"aaaa": ("aaa", "aaa", 2, 1, 20), "aaa": (None, "aaa", 20, 1, None)}
    assert spelling.group_variants(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(rows, 1)


def counted(docs):
    counts = {}
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 2}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = QUERIES["op12_spelling"](spark, folder)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {r["word"]: tuple(r)[1:] for r in rows.collect()}
    wanted = brute(counted(docs))
    assert got == wanted and any(w[0] for w in wanted.values())


def test_words_of_odd_rows(spark, odd, none):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert {r["word"]: r["n"] for r in misspelt_words(odd).collect()} == counted(docs)
    assert misspelt_words(none).count() == 0
