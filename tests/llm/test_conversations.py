import hashlib
import heapq
import random
import re
import zlib

import pytest

from assayloom.llm import conversations
from assayloom.llm.queries import QUERIES

BLANK = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost and audit by a search over whole edit strings: rows of (initial, must go, truncated)."""
    todo, done = [(0, "", 0, "")], set()
    while todo:
        cost, audit, at, roles = heapq.heappop(todo)
        state = (at, roles[:1] == "s", roles[-1:])
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, roles
        if state in done:
            continue
        done.add(state)
        ways = [(2, "I", 0, c) for c in "ua"]
        if at < len(rows):
            initial, gone, cut = rows[at]
            ways.append((3, "D", 1, ""))
            if not gone:
                ways += [(cut, "K", 1, initial)] + [(2 + cut, "R", 1, c) for c in "ua"]
        for price, letter, step, role in ways:
            if letter == "K" and not role:
                continue
            if re.fullmatch("(s|s?(ua)*u?)", roles + role):
                heapq.heappush(todo, (cost + price, audit + letter, at + step, roles + role))


def every_way(rows, most):
    """All edit strings up to a cost, for tiny conversations: no state is merged."""
    out, todo = [], [(0, "", 0, "")]
    while todo:
        cost, audit, at, roles = todo.pop()
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            out.append((cost, audit))
        ways = [(2, "I", 0, c) for c in "ua"]
        if at < len(rows):
            initial, gone, cut = rows[at]
            ways.append((3, "D", 1, ""))
            if not gone:
                ways += [(cut, "K", 1, initial)] + [(2 + cut, "R", 1, c) for c in "ua"]
        for price, letter, step, role in ways:
            if cost + price <= most and not (letter == "K" and not role) and re.fullmatch("(s|s?(ua)*u?)", roles + role):
                todo.append((cost + price, audit + letter, at + step, roles + role))
    return min(out)


def brute(rows):
    """All results of one conversation from its rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, marks = set(), [], []
    for _, role, text in rows:
        end = text.rstrip(BLANK)[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        marks.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, roles = cheapest(marks)
    out, at, emitted = [], 0, iter(roles)
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        name = {"u": "user", "a": "assistant"}.get(next(emitted))
        if letter == "I":
            out.append(f"{name}:")
            continue
        out.append(f"{rows[at][1] if letter == 'K' else name}:{rows[at][2]}")
        at += 1
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(out).encode()).hexdigest()
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, digest)


def found(rows):
    return {r[0]: tuple(r[1:]) for r in rows}


def random_rows(rng, size):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "unknown", "", "useless"]
    texts = ["Yes.", "No!", "cut off", "", " \t", "Really?", "more", "Ends. "]
    return [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(size)]


def test_the_search_finds_the_least_of_all_ways():
    rng = random.Random(7)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(4))]
        cost, audit, _ = cheapest(rows)
        assert every_way(rows, cost) == (cost, audit)


@pytest.mark.parametrize("held_bytes", [conversations.HELD_BYTES, 1])
def test_random_conversations(spark, held_bytes, monkeypatch):
    rng = random.Random(11)
    talks = {i: random_rows(rng, rng.randrange(1, 14)) for i in range(400)}
    talks[None] = random_rows(rng, 9)
    flat = [(k, *r, "x") for k, rows in talks.items() for r in rows]
    rng.shuffle(flat)
    df = spark.createDataFrame(flat, "conv_id long, turn int, role string, text string, present string")
    got = found(conversations.repair_conversations(df, held_bytes=held_bytes).collect())
    assert got == {k: brute(rows) for k, rows in talks.items()}
    left = {}
    for r in conversations.repaired_turns(df, held_bytes=held_bytes).collect():
        left.setdefault(r["conversation"], []).append((r["turn"], f"{r['role']}:{r['text']}", r["edit"]))
    for key, result in got.items():
        lines = sorted(left.get(key, []))
        assert [t for t, _, _ in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(line for _, line, _ in lines).encode()).hexdigest() == result[-1]
        assert "".join(e for _, _, e in lines) == result[-2].replace("D", "")


@pytest.mark.parametrize("size", [3, 4, 5, 8, 9, 17])
def test_blocks_of_any_length(size, monkeypatch):
    monkeypatch.setattr(conversations, "_BLOCK", 4)
    rng = random.Random(size)
    for _ in range(50):
        held, rows = conversations.Conversation(1), []
        for i in range(size):
            role, fault = rng.choice(["user", "assistant", "system", "t"]), rng.choice([None, None, "blank", "truncated"])
            held.add(i, role, str(i), fault)
            rows.append((role[:1], fault == "blank", int(fault == "truncated")))
        cost, edits = held.edits()
        edits = list(edits)
        assert (cost, "".join(e for e, _, _ in edits)) == cheapest(rows)[:2]
        kept = [text for letter, _, text in edits if letter in "KR"]
        assert kept == sorted(kept, key=int)


def test_giant_and_odd_conversations(spark):
    size = 70_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"line {i}.") for i in range(size)]
    rows += [(2, None, None, None), (3, 0, "user", "x" * 300_000 + " " * 300_000 + "."), (3, 0, "user", " " * 300_000)]
    rows += [(4, 5, "assistant", "a."), (4, None, "user", "b."), (4, None, "user", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = found(conversations.repair_conversations(df, held_bytes=1000).collect())
    lines = "\n".join(f"{r}:{t}" for _, _, r, t in rows[:size])
    assert got[1] == (0, 0, 0, 0, 0, 0, "K" * size, hashlib.sha256(lines.encode()).hexdigest())
    assert got[2] == brute([(None, " ", " ")]) and got[3] == brute([r[1:] for r in rows if r[0] == 3])
    assert got[4][:6] == (0, 0, 1, 0, 1, 3)
    assert conversations.repair_conversations(df.limit(0)).count() == 0
    assert conversations.repaired_turns(df.limit(0)).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_brute_force(spark, folder):
    talks = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        kept = talks.setdefault(r["conv_id"], [])
        turn, role, text = r["turn"], r["role"] or " ", r["text"] or " "
        kind = zlib.crc32(f"{r['conv_id']}:{turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    rows = QUERIES["op13_conversations"](spark, folder)
    assert rows.columns[0] == "conv_id" and rows.columns[-2:] == ["audit", "repaired_sha256"]
    assert found(rows.collect()) == {k: brute(rows) for k, rows in talks.items()}


def test_a_conversation_whose_rows_all_go_is_returned(spark, tmp_path):
    key = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(key, 0, "user", "Gone."), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = found(QUERIES["op13_conversations"](spark, str(tmp_path)).collect())
    assert got[key] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and None in got
