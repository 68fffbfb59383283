import re

import pytest

from assayloom.llm import decontamination


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items, width=13):
    own, hit, found = words(text), set(), set()
    for item, item_text in items:
        other = words(item_text)
        if not other:
            continue
        size = min(width, len(other))
        windows = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)}
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(own), len(hit), sorted(found)


ITEMS = [
    (1, "One two three four five, six seven eight nine ten eleven twelve thirteen fourteen"),
    (2, "x"),
    (3, None),
    (4, "!!"),
    (10, "ÄRGER École"),
    (10, "two THREE"),
    (None, "twelve thirteen"),
]


@pytest.mark.parametrize("most", [3, 1000])
def test_odd_rows(spark, odd, none, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = decontamination.find_contamination(odd, items, most_windows=most).collect()
    known = [i for i in ITEMS if i[0] is not None]
    assert len(rows) == odd.count()
    for r in rows:
        n_words, n_hit, found = brute(r["row"]["text"], ITEMS)
        assert (r["n_words"], r["n_hit"]) == (n_words, n_hit)
        assert r["items"] == brute(r["row"]["text"], known)[2]
        for span in r["spans"]:
            piece = r["row"]["text"][span["start"] : span["stop"]]
            assert brute(piece, ITEMS)[1] == len(words(piece)) == span["words"]
        assert sum(span["words"] for span in r["spans"]) == n_hit
    assert decontamination.find_contamination(none, items).count() == 0
    assert {r["n_hit"] for r in decontamination.find_contamination(odd, items.limit(0)).collect()} == {0}
