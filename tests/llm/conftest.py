import pytest

LONG = " ".join(f"word{i % 700}" for i in range(30_000))
SAME = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and columns named like an operator's own."""
    rows = [
        (1, SAME, "a", 1),
        (2, SAME, None, None),
        (2, SAME, None, None),
        (3, None, "b", 2),
        (4, "", None, 3),
        (5, " \t\n", "c", None),
        (6, LONG, "d", 4),
        (7, LONG + " end", "d", 4),
        (8, "x", "e", 5),
        (9, "Ärger ÉCOLE\u0001 naïve 日本語", "e", 5),
        (10, SAME.upper() + "  ", "f", 6),
        (None, "no key here at all", "f", 6),
        (11, "a  b\n c   d \n\n e\t f  ", "g", 7),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, rid int").coalesce(2)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
