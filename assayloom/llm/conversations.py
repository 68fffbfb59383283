"""Repair of the turn structure of conversations, by secondary-sorted streaming.

Rows are partitioned by conversation and sorted by turn inside a partition; one task reads them as a stream of Arrow batches. A
conversation's state goes from batch to batch: counters, and one byte per row (initial of the role, fault). When it ends, a dynamic
programme runs backwards over those bytes: the cheapest way to finish from every row and state of the pattern, with the first
letter of the least such way. These backpointers are one byte per row as well. Following them forwards gives the edits.

Bytes, backpointers and texts of a conversation stay in memory up to ``HELD_BYTES`` each and go on in unnamed files of the task
beyond, so a conversation of any length needs bounded memory beside its audit. The files end with the task, nothing else reads them.

States of the pattern ``(s?(ua)+)?``: 0 at the start, 1 after the system row, 2 after a user row, 3 after an assistant row.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from assayloom.llm.rows import map_batches

# Costs of the edits, and the initials that may follow each other.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
LEGAL = frozenset(("su", "ua", "au"))

HELD_BYTES = 1 << 22
_BLOCK = 1 << 16
_NEVER = 1 << 60
#: State after a row of the given role in each state, and after a new or changed row.
_KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_NEXT = (2, 2, 3, 2)
_LETTERS = b"DIKR"
_SPOKEN = {2: "user", 3: "assistant"}
_GONE, _CUT = 4, 8
_INITIALS = "sua"


def _step(code: int, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs of finishing before a row from those behind it, and the edits to begin with, two bits a state."""
    keep = _KEEP.get(_INITIALS[code & 3] if code & 3 < 3 else "", (None,) * 4)
    gone, cut = code & _GONE, TRUNCATED if code & _CUT else 0
    ways = []
    for state in range(4):
        kept = _NEVER if gone or keep[state] is None else cut + ahead[keep[state]]
        changed = _NEVER if gone else REROLE + cut + ahead[_NEXT[state]]
        ways.append((DELETE + ahead[state], kept, changed))
    return _chosen(ways)


def _chosen(ways: list[tuple[int, int, int]]) -> tuple[tuple[int, ...], int]:
    """The cheapest way of each state, new rows before the present one included; of equal ones the least letter."""
    plain = [min(w) for w in ways]
    user = min(plain[2], INSERT + plain[3])
    assistant = min(plain[3], INSERT + plain[2])
    best = (min(plain[0], INSERT + user), min(plain[1], INSERT + user), user, assistant)
    inserted = (INSERT + user, INSERT + user, INSERT + assistant, INSERT + user)
    edits = 0
    for state, (deleted, kept, changed) in enumerate(ways):
        letters = (deleted, inserted[state], kept, changed)
        edits |= letters.index(best[state]) << 2 * state
    return best, edits


def _finish() -> tuple[tuple[int, ...], int]:
    """Costs and edits behind the last row: states 0 and 3 are done."""
    user = INSERT
    return (0, INSERT + user, user, 0), 1 << 2 | 1 << 4


class Conversation:
    """One conversation, fed row by row."""

    def __init__(self, held_bytes: int = HELD_BYTES) -> None:
        self.codes = tempfile.SpooledTemporaryFile(held_bytes)  # noqa: SIM115
        self.texts = tempfile.SpooledTemporaryFile(held_bytes)  # noqa: SIM115
        self.held_bytes = held_bytes
        self.rows = self.illegal = self.turns = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.before = None

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        initial = role[:1]
        if self.rows and (self.before + initial) not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.rows += 1
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        code = _INITIALS.index(initial) if initial and initial in _INITIALS else 3
        if fault:
            self.faults[fault] += 1
            code |= _CUT if fault == "truncated" else _GONE
        self.codes.write(bytes((code,)))
        if not code & _GONE:
            role_, text_ = role.encode(), text.encode()
            self.texts.write(struct.pack("<QQ", len(role_), len(text_)) + role_ + text_)

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns

    def _backpointers(self):
        """Costs of finishing from the start, and a file with the edits of every row and state, the last row's first."""
        pointers = tempfile.SpooledTemporaryFile(self.held_bytes)  # noqa: SIM115
        ahead, edits = _finish()
        pointers.write(bytes((edits,)))
        known: dict[tuple, tuple] = {}
        for start in range((self.rows - 1) // _BLOCK * _BLOCK, -1, -_BLOCK):
            self.codes.seek(start)
            for code in reversed(self.codes.read(_BLOCK)):
                # Costs differ by a bounded amount, so there are few different steps; the least of them is added again.
                least = min(ahead)
                key = code, tuple(a - least for a in ahead)
                if key not in known:
                    known[key] = _step(*key)
                step, edits = known[key]
                ahead = tuple(a + least for a in step)
                pointers.write(bytes((edits,)))
        return ahead, pointers

    def edits(self) -> tuple[int, Iterator[tuple[str, str | None, str | None]]]:
        """The cost and the edits in order: letter, and role and text of the row that it leaves or makes (nulls if none)."""
        ahead, pointers = self._backpointers()
        return ahead[0], self._followed(pointers)

    def _followed(self, pointers) -> Iterator[tuple[str, str | None, str | None]]:
        self.texts.seek(0)
        self.codes.seek(0)
        state, at, size = 0, 0, self.rows + 1
        while at < size:
            count = min(_BLOCK, size - at)
            pointers.seek(size - at - count)
            block = pointers.read(count)[::-1]
            codes = self.codes.read(count)
            for i, edits in enumerate(block):
                while True:
                    if at + i == self.rows and state in (0, 3):
                        return
                    letter = _LETTERS[edits >> 2 * state & 3 : (edits >> 2 * state & 3) + 1].decode()
                    if letter != "I":
                        break
                    state = _NEXT[state]
                    yield "I", _SPOKEN[state], ""
                row = (None, None) if codes[i] & _GONE else self._text()
                if letter == "D":
                    yield "D", None, None
                elif letter == "K":
                    state = _KEEP[_INITIALS[codes[i] & 3]][state]
                    yield "K", *row
                else:
                    state = _NEXT[state]
                    yield "R", _SPOKEN[state], row[1]
            at += count

    def _text(self) -> tuple[str, str]:
        role, text = struct.unpack("<QQ", self.texts.read(16))
        return self.texts.read(role).decode(), self.texts.read(text).decode()

    def close(self) -> None:
        self.codes.close()
        self.texts.close()


def _prepared(df: DataFrame, conversation: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    """``conversation, turn, role, text, present, fault``, partitioned by conversation and sorted by turn."""
    there = F.coalesce(F.col(f"`{present}`"), F.lit(False)) if present else F.lit(True)
    rows = df.select(
        F.col(f"`{conversation}`").alias("conversation"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
        there.alias("present"),
    ).repartition("conversation")
    same = Window.partitionBy("conversation", "present", "role", "text").orderBy("turn")
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = (
        F.when(~F.col("present"), None)
        .when(end == "", "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~end.isin(".", "!", "?"), "truncated")
    )
    faulty = rows.withColumn("fault", fault)
    return faulty.sortWithinPartitions("conversation", "turn", "role", "text")


def _streamed(batches: Iterator[pa.RecordBatch], held_bytes: int) -> Iterator[tuple[object, Conversation]]:
    """Every conversation when its last row has come."""
    name, held = None, None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for key, turn, role, text, present, fault in zip(*columns):
            if held is None or key != name:
                if held is not None:
                    yield name, held
                    held.close()
                name, held = key, Conversation(held_bytes)
            if present:
                held.add(turn, role, text, fault)
    if held is not None:
        yield name, held
        held.close()


def _mapped(prepared: DataFrame, fields: list[StructField], rows_of: Callable, held_bytes: int) -> DataFrame:
    kind = prepared.schema["conversation"].dataType
    schema = StructType([StructField("conversation", kind), *fields])
    names = schema.names

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, arrow = [], 0, None

        def packed() -> pa.RecordBatch:
            columns = list(zip(*waiting))
            kinds = [arrow] + [pa.string() if isinstance(f.dataType, StringType) else pa.int64() for f in fields]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        def noted() -> Iterator[pa.RecordBatch]:
            nonlocal arrow
            for batch in batches:
                arrow = batch.schema.field(0).type
                yield batch

        for name, held in _streamed(noted(), held_bytes):
            for row in rows_of(held):
                waiting.append((name, *row))
                size += 100 + sum(len(v) for v in row if isinstance(v, str))
                if size > 1 << 20:
                    yield packed()
                    waiting, size = [], 0
        if waiting:
            yield packed()

    return map_batches(prepared, schema, work, rows=1024)


def repair_conversations(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: str | None = None,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """One row per conversation: ``conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows of a conversation go by turn, null turns first, then by role and text. Null roles and texts count as one blank. A row's
    first fault counts: blank, duplicate (role and text of an earlier row), truncated (not ending in ``.!?``). ``gaps`` are turns
    missing between the first and the last, ``illegal`` neighbours of roles other than system-user, user-assistant and
    assistant-user. ``audit`` has the cheapest edits (Delete, Insert, Keep, Rerole) that leave an optional system row and pairs of
    user and assistant, of equally cheap ones the ASCII-least; ``cost`` is theirs and ``repaired_sha256`` the hash of the
    ``role:text`` lines that they leave. Rows whose ``present`` is false or null count for nothing, but their conversation is
    returned. Null conversations are one conversation; their numbers are not floating. Repeated rows are duplicates of each
    other; columns other than the named ones are not read; an empty table gives an empty result.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = [StructField(n, LongType()) for n in names] + [StructField(n, StringType()) for n in ("audit", "repaired_sha256")]

    def summary(held: Conversation) -> Iterator[tuple]:
        cost, edits = held.edits()
        letters, digest, lines = bytearray(), hashlib.sha256(), 0
        for letter, role_, text_ in edits:
            letters += letter.encode()
            if role_ is not None:
                digest.update(f"{chr(10) if lines else ''}{role_}:{text_}".encode())
                lines += 1
        yield held.gaps(), *held.faults.values(), held.illegal, cost, letters.decode(), digest.hexdigest()

    return _mapped(_prepared(df, conversation, turn, role, text, present), fields, summary, held_bytes)


def repaired_turns(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    present: str | None = None,
    held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """The rows of the repaired conversations: ``conversation, turn`` (from 0, without gaps), ``role, text, edit`` (I, K or R)."""
    fields = [StructField("turn", LongType())] + [StructField(n, StringType()) for n in ("role", "text", "edit")]

    def left(held: Conversation) -> Iterator[tuple]:
        rows = ((role_, text_, letter) for letter, role_, text_ in held.edits()[1] if role_ is not None)
        yield from ((i, *row) for i, row in enumerate(rows))

    return _mapped(_prepared(df, conversation, turn, role, text, present), fields, left, held_bytes)
