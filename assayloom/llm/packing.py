"""Packing of tokenised documents into windows of several context sizes.

Every task packs its own documents, batch by batch. Whole windows of the longest size are cut off first. What is left of a
document goes to the tier of the smallest window that holds it. Tiers are packed from the longest to the shortest: a window
opens with its tier's longest piece, its gap is filled with the largest pieces that fit, which come from shorter tiers, and
where none fits a piece is cut to close it. What fills no window waits for the next batch; at the end of the partition it
is cut into sequences of power-of-two lengths. Windows of a tier are dealt to step groups of equal token counts.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from tokenizers import Tokenizer

from assayloom.llm.rows import map_batches, text_of, whole

TIERS = (128, 256, 512, 1024)
END_ID = 0
#: Tokens in one step group, whatever the tier.
STEP_TOKENS = 65_536
#: Documents encoded and packed together.
DOCS_TOGETHER = 512
#: Words whose ids a worker remembers.
MOST_WORDS = 400_000

_ENCODERS: dict[str, "Encoder"] = {}
#: A blank that white space, or nothing, follows.
_WIDE_GAP = re.compile(r" (?:[\s\x1c-\x1f]|$)")


# The byte-level pre-tokeniser's pattern, and the bytes that it writes as themselves.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes, if its merges stand in the order of their ids; such a vocabulary needs no merge list."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, cut = said["model"], said.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    if model.get("type", "BPE") != "BPE" or not plain or said.get("normalizer"):
        return None
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids):
        return None
    hidden = (b for b in range(256) if b not in PRINTED_BYTES)
    byte_of = {chr(b): b for b in PRINTED_BYTES} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in said.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in word): i for word, i in model["vocab"].items() if word not in special}


class _Words(dict):
    """Ids of words that follow a blank, as bytes; a new word is encoded when it is first asked for."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self[word] = array("I", self.encode(" " + word)).tobytes()
        return found


class Encoder:
    """Ids of whole texts, as ``tokenizers`` gives them; words seen before are looked up.

    A byte-level pre-tokeniser never joins what stands before and after the place in front of a single blank that a visible
    character follows. So a text is cut there, and the ids of its words in a row are the ids of the text. New words go through
    a byte-pair encoder over the same vocabulary where its merge order allows, else, and for special tokens, through the
    tokeniser itself.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _byte_ranks(path)
        self.fast = ranks and tiktoken.Encoding(
            "words", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.known = _Words(self.ids)

    def ids(self, text: str) -> list[int]:
        if not self.fast or any(s in text for s in self.special):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def one(self, text: str) -> np.ndarray:
        if any(" " in s for s in self.special):
            return np.array(self.ids(text), np.uint32)
        first, *words = text.split(" ")
        if _WIDE_GAP.search(text):
            joined: list[str] = []
            for word in words:
                if not word or word[0].isspace():
                    if joined:
                        joined[-1] += " " + word
                    else:
                        first += " " + word
                else:
                    joined.append(word)
            words = joined
        start = array("I", self.ids(first)).tobytes()
        return np.frombuffer(start + b"".join(map(self.known.__getitem__, words)), np.uint32)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        return [self.one(t) for t in texts]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Pool:
    """Pieces (document, start, length) by length; finds the largest that fits and the smallest that does not."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.lengths = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.by_length[length].append((doc, start))
        self.lengths |= 1 << length

    def _pop(self, length: int) -> tuple[int, int, int]:
        doc, start = self.by_length[length].pop()
        if not self.by_length[length]:
            self.lengths &= ~(1 << length)
        return doc, start, length

    def largest(self, most: int) -> tuple[int, int, int] | None:
        fitting = self.lengths & ((1 << (most + 1)) - 1)
        return self._pop(fitting.bit_length() - 1) if fitting else None

    def cut(self, length: int) -> tuple[int, int, int] | None:
        """The first ``length`` tokens of the smallest longer piece; the rest stays."""
        longer = self.lengths >> (length + 1)
        if not longer:
            return None
        doc, start, had = self._pop((longer & -longer).bit_length() + length)
        self.put(doc, start + length, had - length)
        return doc, start, length


def fill(pool: Pool, room: int, first: tuple[int, int, int] | None = None) -> list[tuple[int, int, int]]:
    """Pieces for one window; they fill it unless the pool runs dry."""
    pieces = [first] if first else []
    room -= sum(p[2] for p in pieces)
    while room:
        piece = pool.largest(room) or pool.cut(room)
        if piece is None:
            break
        pieces.append(piece)
        room -= piece[2]
    return pieces


def pack_tiers(pool: Pool, tiers: Sequence[int]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Full windows from the longest tier down; what fills none goes back to the pool."""
    for at in range(len(tiers) - 1, -1, -1):
        tier, shorter = tiers[at], tiers[at - 1] if at else 0
        while pool.lengths.bit_length() - 1 > shorter:
            pieces = fill(pool, tier, pool.largest(tier))
            if sum(p[2] for p in pieces) < tier:
                for piece in pieces:
                    pool.put(*piece)
                return
            yield tier, pieces


def pack_rest(pool: Pool, longest: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Everything left, in sequences of power-of-two lengths."""
    left = sum(length * len(pieces) for length, pieces in pool.by_length.items())
    while left:
        room = min(longest, 1 << (left.bit_length() - 1))
        yield room, fill(pool, room)
        left -= room


def pack(
    docs: DataFrame,
    tokenizer: str,
    text: str | Column = "text",
    carry: Sequence[str] = ("doc_id",),
    tiers: Sequence[int] = TIERS,
    end_id: int = END_ID,
    ids: bool = True,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece: ``row`` (the carried columns), start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    step_group and, with ``ids``, the piece's ``ids``.

    Every document is its ids and one ``end_id``; a null or empty text is that id alone. Tiers are powers of two, ascending.
    Each id lies in one piece, documents are cut freely, and every sequence is exactly as long as its tier or, at the end of a
    partition, a power of two. Repeated rows are packed one by one; an empty table gives an empty result.
    """
    tiers = sorted(tiers)
    longest = tiers[-1]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), text_of(text).alias("text"))
    schema = StructType().add(source.schema["row"])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, LongType())
    schema = schema.add("tier", IntegerType()).add("step_group", LongType())
    if ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer).encode, TaskContext.get().partitionId() << 33
        pool, tokens, rows, number = Pool(), {}, {}, 0
        made: dict[int, int] = defaultdict(int)
        row_type = None

        def written(windows: Iterator[tuple[int, list[tuple[int, int, int]]]]) -> pa.RecordBatch:
            out: list[tuple] = []
            held = []
            nonlocal number
            for tier, pieces in windows:
                sequence, offset = base + number, 0
                group = base + (tier << 22) + made[tier] // max(1, step_tokens // tier)
                number += 1
                made[tier] += 1
                for doc, start, length in pieces:
                    part = tokens[doc][start : start + length]
                    crc = zlib.crc32(part.tobytes())
                    out.append((rows[doc], start, length, crc, len(tokens[doc]), sequence, offset, tier, group))
                    if ids:
                        held.append(part.astype(np.int32))
                    offset += length
            columns = list(zip(*out)) if out else [()] * 9
            kinds = [row_type, *[pa.int64()] * 6, pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            if ids:
                arrays.append(pa.array(held, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        count = 0
        for batch in batches:
            row_type, full = batch.schema.field("row").type, []
            for row, found in zip(whole(batch, "row"), encode(whole(batch, "text"))):
                tokens[count], rows[count] = np.append(found, np.uint32(end_id)), row
                length = len(tokens[count])
                full += [(longest, [(count, i, longest)]) for i in range(0, length - longest + 1, longest)]
                if length % longest:
                    pool.put(count, length - length % longest, length % longest)
                count += 1
            yield written(iter(full))
            yield written(pack_tiers(pool, tiers))
            waiting = {doc for pieces in pool.by_length.values() for doc, _ in pieces}
            tokens = {doc: tokens[doc] for doc in waiting}
            rows = {doc: rows[doc] for doc in waiting}
        if count:
            yield written(pack_rest(pool, longest))

    return map_batches(source, schema, work, DOCS_TOGETHER)
