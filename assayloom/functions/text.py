"""Text expressions: canonical keys, tokens, fixed windows, hashed fingerprints."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # The same digests as hashlib's at a third of its cost per call, which is what short runs pay for.
    from _md5 import md5
except ImportError:
    from hashlib import md5

MAX_TOKENS = 512
FINGERPRINT_BITS = 2048
FINGERPRINT_GRAM = 3
PAD_ID, UNKNOWN_ID = 0, 1
RESERVED_IDS = 2
#: Tokens, and texts, that a batch is cut into.
TOKENS_AT_ONCE, ROWS_AT_ONCE = 200_000, 512

_TOKEN = r"[^\s]+"
_SPACES = r"\s+"


def canonical_key(text: Column) -> Column:
    """Lower case, single spaces, no outer space; null for blank text."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), _SPACES, " ")), F.lit(""))


def tokens(text: Column) -> Column:
    """White-space separated tokens of the lower-cased text, empty array for blank text."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def token_places(token_array: Column) -> Column:
    """``array<struct<token, places>>``: each different token with the places where it stands, from 0.

    Tokens are sorted with their places, and every run of equal ones is cut out; so a text of n tokens takes n log n steps.
    """

    def runs(pairs: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(pairs) - 1),
            lambda i: (i == 0) | (F.get(pairs, i)["token"] != F.get(pairs, i - 1)["token"]),
        )
        return bound(F.array_append(starts, F.size(pairs)), lambda ends: cut(pairs, ends))

    def cut(pairs: Column, ends: Column) -> Column:
        def one(n: Column) -> Column:
            at = F.get(ends, n)
            places = F.transform(F.slice(pairs, at + 1, F.get(ends, n + 1) - at), lambda p: p["place"])
            return F.struct(F.get(pairs, at)["token"].alias("token"), places.alias("places"))

        return F.transform(F.sequence(F.lit(0), F.size(ends) - 2), one)

    pairs = F.array_sort(F.transform(token_array, lambda t, i: F.struct(t.alias("token"), i.alias("place"))))
    return bound(pairs, lambda p: F.when(F.size(p) > 0, runs(p)).otherwise(F.array().cast("array<struct<token:string,places:array<int>>>")))


def truncated(sequence: Column, length: int = MAX_TOKENS) -> Column:
    return F.slice(sequence, 1, length)


def padded(ids: Column, length: int = MAX_TOKENS, pad: int = PAD_ID) -> Column:
    """The first ``length`` ids, filled up with ``pad``."""
    fill = F.array_repeat(F.lit(pad), F.lit(length))
    return F.slice(F.concat(truncated(ids, length), fill), 1, length)


def attention_mask(ids: Column, length: int = MAX_TOKENS) -> Column:
    """1 for every real position of the padded window, 0 for the fill."""
    ones, zeros = F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), F.lit(length))
    return F.slice(F.concat(truncated(ones, length), zeros), 1, length)


def hash_bucket(text: Column, buckets: int) -> Column:
    """A stable bucket number from the first 32 bits of the MD5 digest."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def hashed_ids(token_array: Column, table_size: int) -> Column:
    """Token ids without a vocabulary: a hash bucket per token, above the reserved ids."""
    return F.transform(token_array, lambda t: hash_bucket(t, table_size - RESERVED_IDS) + F.lit(RESERVED_IDS))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    An expression that a lambda refers to is otherwise computed again for every array element the lambda visits.
    """
    return F.transform(F.array(value), lambda v: use(v))[0]


def _run_buckets(words: pa.Array, rows: np.ndarray, bits: int, longest: int) -> np.ndarray:
    """``row * bits + bucket`` of every run of 1 to ``longest`` words of one row, once each and sorted."""
    runs, keys = words, [np.zeros(0, np.int64)]
    for n in range(1, longest + 1):
        places = np.arange(max(len(words) - n + 1, 0))
        if n == 1:
            coded = runs.dictionary_encode()
            texts, codes = coded.dictionary, coded.indices.to_numpy()
        else:
            runs = pc.binary_join_element_wise(runs.slice(0, len(places)), words.slice(n - 1), " ")
            places = places[rows[places] == rows[places + n - 1]]
            texts, codes = runs.take(pa.array(places)), slice(None)
        digests = b"".join([md5(t).digest()[:4] for t in texts.cast(pa.large_binary()).to_numpy(zero_copy_only=False)])
        keys.append(rows[places] * bits + (np.frombuffer(digests, ">u4").astype(np.int64) % bits)[codes])
    found = np.sort(np.concatenate(keys))
    return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def _fingerprints(tokens: pa.Array, bits: int, longest: int, least_tokens: int) -> pa.Array:
    """Sorted buckets of every row's token runs. Rows are taken in groups of some :data:`TOKENS_AT_ONCE`, none is cut."""
    words, ends = tokens.flatten(), tokens.offsets.to_numpy().astype(np.int64)
    ends, found, sizes, start = ends - ends[0], [np.zeros(0, np.int32)], np.zeros(len(tokens), np.int64), 0
    while start < len(tokens):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + TOKENS_AT_ONCE, "right")) - 1)
        rows = np.repeat(np.arange(stop - start), np.diff(ends[start : stop + 1]))
        keys = _run_buckets(words.slice(ends[start], ends[stop] - ends[start]), rows, bits, longest)
        sizes[start:stop] = np.bincount(keys // bits, minlength=stop - start)
        found.append((keys % bits).astype(np.int32))
        start = stop
    missing = ~tokens.is_valid().to_numpy(zero_copy_only=False) | (np.diff(ends) < least_tokens)
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)), mask=pa.array(missing))


def _split(texts: pa.Array) -> pa.Array:
    """The tokens of lower-cased texts, as :func:`tokens` gives them."""
    parts = pc.ascii_split_whitespace(texts)
    words, ends = parts.flatten(), parts.offsets.to_numpy()
    real = pc.not_equal(words, "")
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False))).astype(np.int32)
    missing = pa.array(~texts.is_valid().to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array(before[ends - ends[0]]), words.filter(real), mask=missing)


def _described(column: Column, split: bool, bits: int, longest: int, least_tokens: int) -> Column:
    def buckets(values: pa.Array) -> pa.Array:
        parts = [values.slice(at, ROWS_AT_ONCE) for at in range(0, max(len(values), 1), ROWS_AT_ONCE)]
        found = pa.concat_arrays([_fingerprints(_split(p) if split else p, bits, longest, least_tokens) for p in parts])
        # A worker stays, and what it holds unused is missing elsewhere.
        pa.default_memory_pool().release_unused()
        return found

    # Not to be computed again for every place that a plan moves or copies the column to.
    return F.arrow_udf(buckets, "array<int>").asNondeterministic()(column)


def fingerprint(token_array: Column, bits: int = FINGERPRINT_BITS, longest: int = FINGERPRINT_GRAM) -> Column:
    """Sorted positions of the bits set by the hashed token runs: a sparse 0/1 vector of width ``bits``."""
    return _described(token_array, False, bits, longest, 0)


def usable_fingerprint(token_array: Column, least_tokens: int = 1, bits: int = FINGERPRINT_BITS) -> Column:
    """The fingerprint, or null for text with too few tokens to describe."""
    return _described(token_array, False, bits, FINGERPRINT_GRAM, least_tokens)


def text_fingerprint(text: Column, bits: int = FINGERPRINT_BITS, longest: int = FINGERPRINT_GRAM, least_tokens: int = 0) -> Column:
    """The fingerprint of a text's tokens, split where they are hashed; null for text with fewer tokens than ``least_tokens``."""
    return _described(F.lower(text), True, bits, longest, least_tokens)


# The escape sign of written text files (a control sign that texts of other writers hardly hold), and its uses.
ESCAPE = "\x1b"
NULL_MARK = f"{ESCAPE}N"
ESCAPES = (("\n", "n"), ("\r", "r"))


def escaped(text: Column) -> Column:
    """The text on one line; the empty text has a mark, so that it differs from null."""
    for sign, letter in ((ESCAPE, "e"), *ESCAPES):
        text = F.replace(text, F.lit(sign), F.lit(ESCAPE + letter))
    return F.when(text == "", F.lit(f"{ESCAPE}0")).otherwise(text)


def unescaped(text: Column) -> Column:
    text = F.replace(text, F.lit(f"{ESCAPE}0"), F.lit(""))
    for sign, letter in (*ESCAPES, (ESCAPE, "e")):
        text = F.replace(text, F.lit(ESCAPE + letter), F.lit(sign))
    return text
