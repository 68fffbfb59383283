import hashlib
import re

from pyspark.sql import functions as F

from assayloom.llm import pii
from assayloom.llm.queries import QUERIES

# The patterns as they are stated, without the guards that keep the scan linear.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m.group())]
    return out


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_equals_plain_patterns(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op4_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wanted = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in wanted) for k in PLAIN]
        assert r["base_sha256"] == hashlib.sha256(written(wanted).encode()).hexdigest()
        assert set(filter(None, written(wanted).split(","))) <= set(r["spans"].split(","))


def test_odd_texts(spark, odd, none):
    texts = [
        "a@b.c@d.e x%y@z.q%r@s.t.u.v",
        "a@b.c.d@e.f",
        "@a.b a@b a@.c",
        "1.2.3.4.5.6.7.8 300.1.1.1 00255.1.1.1 1.2.3 12345678901234567890.1.1.1",
        "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111 1111 1111 5500000000000004",
        "+1 (415) 555-2671 and +44.20.7946.0958- +1 +123456789 +1234567890123456",
        "日本 é 4111111111111111 é a@b.cd \U0001f600 1.2.3.4",
        "7 " * 30_000 + "4111111111111111",
        "a" * 100_000 + "@" + "b." * 20_000 + "c",
        "x12345678 " * 3_000,
    ]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = pii.find_personal_data(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        base = [(pii.KINDS[s["rank"]], s["start"], s["stop"]) for s in r["base"]]
        assert base == brute(r["row"]["text"])
    assert pii.find_personal_data(none).count() == 0
    assert pii.find_personal_data(odd).select("row.*").columns == odd.columns


def test_contexts_find_what_patterns_miss(spark):
    """Hexadecimal tokens after the same words teach the context; a token of another form is then found, others are not."""
    secrets = [f'{w} api key = "{hashlib.md5(str(i).encode()).hexdigest()}" end' for i in range(40) for w in ("the", "my")]
    others = [f"see page{i:05d} of the book{i:05d} = {i:06d}" for i in range(40)]
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate([*secrets, *others, 'use api key = "Zz-99-other-form-7q" now', None, ""])], "doc_id long, text string"
    )
    rows = {r["row"]["text"]: [(pii.KINDS[s["rank"]], s["start"], s["stop"]) for s in r["spans"]] for r in pii.find_personal_data(docs).collect()}
    new = 'use api key = "Zz-99-other-form-7q" now'
    assert rows[new] == [("secret", 15, 34)] and new[15:34] == "Zz-99-other-form-7q"
    assert all(rows[t] == [("secret", t.index('"') + 1, t.rindex('"'))] for t in secrets)
    assert not any(rows[t] for t in others)


def test_copies_do_not_make_a_pattern(spark):
    text = f'set tok = "{"ab" * 20}"'
    docs = spark.createDataFrame([(i, text) for i in range(100)] + [(1000, 'set tok = "other-1-form"')], "doc_id long, text string")
    assert pii.find_personal_data(docs).where(F.size("spans") > 0).count() == 0


def test_thousands_of_spans_in_one_text_stay_cheap(spark):
    """A log of 1 MB: every line has an address and a token of another form; each token looks its spans up by halving."""
    import time

    def seconds(lines):
        text = "".join(f"from 10.{i % 250}.{i // 250 % 250}.7 to a{i}@b.cd as x{i:07d} {'ok ' * 8}\n" for i in range(lines))
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        start = time.perf_counter()
        row = pii.find_personal_data(docs).first()
        assert len(row["base"]) == 2 * lines and all(s["start"] < s["stop"] for s in row["base"])
        return time.perf_counter() - start, len(text)

    seconds(10)
    few, _ = seconds(2_000)
    many, size = seconds(16_000)
    assert size > 1_000_000 and many < 16 * few + 20


def test_tokens_meet_the_kind_that_they_overlap(spark):
    text = "a1@b.cd 4111111111111111 x +1 (415) 555-2671 10.0.0.1 abc123def 99 y1234567"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kinds = pii.spans_of(docs, "text", pii._PATTERNS | {"token": pii._TOKEN})
    kinds = kinds.withColumns({f"valid_{k}": pii.valid_spans(k) for k in PLAIN}).withColumns({"base": pii.base_spans(), "tokens": pii.candidate_tokens()})
    row = kinds.select("base", "tokens").first()
    wanted = {}
    for t in row["tokens"]:
        met = [b["rank"] for b in row["base"] if b["start"] < t["stop"] and t["start"] < b["stop"]]
        wanted[text[t["start"] : t["stop"]]] = (met[0] if met else None, bool(met))
        assert (t["rank"], t["in_base"]) == wanted[text[t["start"] : t["stop"]]]
    assert wanted["a1@b.cd"] == (0, True) and wanted["abc123def"] == (None, False) and len(wanted) >= 5
