"""Text quality by a factorisation machine over hashed words and structure.

A document is a sparse vector: its words, hashed into ``BUCKETS`` places and scaled to length one, and a few numbers about its
structure and size. Besides a weight per place the machine has a short vector per place; the interaction of two places is the
product of their vectors. All pairs are scored in linear time by ½ Σ_f ((Σ_i v_if x_i)² - Σ_i v_if² x_i²).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from assayloom.llm.labelled import fold, training_rows
from assayloom.llm.rows import TEXT_ROWS, boxed_texts, map_batches, texts_in

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: The machine is fitted on at most this many labelled documents.
MOST_TRAINING_ROWS = 8_192
BUCKETS = 1 << 14
FACTORS = 8
EPOCHS = 6
#: Few rows are gone through more often, up to this many steps.
LEAST_STEPS = 600
BATCH = 128
RATE = 0.08
DECAY = 1e-4
SEED = 7

_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
STRUCTURE = (
    "log_words", "log_chars", "mean_word", "upper_share", "mark_share", "digit_share", "distinct_share", "repeat_share",
    "top_share", "bare_mark_share", "marked_end_share", "log_line", "repeated_line_share", "title_share",
)


class _Places(dict):
    """Hashed place of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        found = zlib.crc32(word) % BUCKETS
        if len(self) < 200_000:
            self[word] = found
        return found


_PLACES = _Places()


def structure(raw: bytes, words: list[bytes]) -> list[float]:
    """The numbers named in ``STRUCTURE``."""
    n, size = max(len(words), 1), max(len(raw), 1)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    removed = lambda letters: (size - len(raw.translate(None, letters))) / size if raw else 0.0
    ends = sum(len(w) - len(w.rstrip(_MARKS)) >= 2 for w in words)
    return [
        np.log1p(len(words)),
        np.log1p(len(raw)),
        sum(map(len, words)) / n,
        removed(_UPPER),
        removed(_MARKS),
        removed(_DIGITS),
        len(counts) / n,
        repeats / n,
        max(counts.values(), default=0) / n,
        sum(not w.strip(_MARKS) for w in words) / n,
        ends / n,
        np.log1p(size / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1),
        sum(w[:1].isupper() for w in words) / n,
    ]


def features(text: str) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Places and values of the words, and the structure numbers."""
    raw = text.encode("utf-8")
    words = raw.split()
    places = np.fromiter(map(_PLACES.__getitem__, raw.lower().split()), np.int32, len(words))
    found, counts = np.unique(places, return_counts=True)
    values = np.sqrt(counts).astype(np.float32)
    norm = float(np.sqrt((values**2).sum()))
    return found, values / norm if norm else values, structure(raw, words)


@dataclass
class Rows:
    """Sparse rows end to end: ``places`` and ``values`` of row i are those from ``starts[i]`` to ``starts[i + 1]``."""

    starts: np.ndarray
    places: np.ndarray
    values: np.ndarray


def joined(parts: Sequence[tuple[np.ndarray, np.ndarray, list[float]]], centre: np.ndarray, scale: np.ndarray) -> Rows:
    shape = np.array([p[2] for p in parts]).reshape(len(parts), len(STRUCTURE))
    dense = (np.clip((shape - centre) / scale, -4, 4) * 0.25).astype(np.float32)
    own = np.arange(BUCKETS, BUCKETS + len(STRUCTURE), dtype=np.int32)
    places = [np.concatenate([p[0], own]) for p in parts]
    values = [np.concatenate([p[1], d]) for p, d in zip(parts, dense)]
    starts = np.append(0, np.cumsum([len(p) for p in places]))
    return Rows(starts, np.concatenate(places), np.concatenate(values)) if parts else Rows(starts, np.empty(0, np.int32), np.empty(0))


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def sums(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Margins, and Σ v x per row and factor."""
        if len(rows.starts) == 1:
            return np.empty(0), np.empty((0, self.factors.shape[1]))
        at = rows.starts[:-1]
        linear = np.add.reduceat(self.weights[rows.places] * rows.values, at)
        mixed = self.factors[rows.places] * rows.values[:, None]
        total = np.add.reduceat(mixed, at, axis=0)
        squares = np.add.reduceat(mixed * mixed, at, axis=0)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1), total

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        rows = joined([features(t) for t in texts], self.centre, self.scale)
        return 1 / (1 + np.exp(-np.clip(self.sums(rows)[0], -30, 30)))


def fit(texts: Sequence[str], labels: Sequence[int]) -> FactorisationMachine:
    """Logistic loss, mini-batches in a seeded order, steps scaled per parameter. Without rows every score is one half."""
    parts = [features(t) for t in texts]
    shape = np.array([p[2] for p in parts]).reshape(len(parts), len(STRUCTURE))
    centre = shape.mean(axis=0) if len(parts) else np.zeros(len(STRUCTURE))
    scale = np.maximum(shape.std(axis=0), 1e-3) if len(parts) else np.ones(len(STRUCTURE))
    rng, size = np.random.default_rng(SEED), BUCKETS + len(STRUCTURE)
    model = FactorisationMachine(
        0.0, np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32), centre, scale
    )
    if not len(parts):
        model.factors[:] = 0
        return model
    truth = np.array(labels, float)
    share = (truth.sum() + 1) / (len(truth) + 2)
    model.bias = float(np.log(share / (1 - share)))
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // len(parts))):
        order = rng.permutation(len(parts))
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            rows = joined([parts[j] for j in chosen], centre, scale)
            margins, total = model.sums(rows)
            error = (1 / (1 + np.exp(-np.clip(margins, -30, 30))) - truth[chosen]) / len(chosen)
            each = np.repeat(np.arange(len(chosen)), np.diff(rows.starts))
            used, inverse = np.unique(rows.places, return_inverse=True)
            pull = error[each] * rows.values
            step_w = np.bincount(inverse, pull, len(used)) + DECAY * model.weights[used]
            mixed = pull[:, None] * (total[each] - model.factors[rows.places] * rows.values[:, None])
            step_v = np.stack([np.bincount(inverse, mixed[:, f], len(used)) for f in range(FACTORS)], axis=1)
            step_v += DECAY * model.factors[used]
            seen_w[used] += step_w**2
            seen_v[used] += step_v**2
            seen_b += error.sum() ** 2
            model.weights[used] -= RATE * step_w / np.sqrt(seen_w[used])
            model.factors[used] -= RATE * step_v / np.sqrt(seen_v[used])
            model.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_TRAINING_ROWS) -> FactorisationMachine:
    """Fitted on the labelled rows outside the held-out fold, ``most`` at the most."""
    rows = training_rows(docs, labels, label, FOLDS, HELD_OUT, most).orderBy("key").toPandas()
    return fit(rows["text"].tolist(), rows["label"].tolist())


def score_quality(
    docs: DataFrame, model: FactorisationMachine, text: str = "text", carry: Sequence[str] | None = None
) -> DataFrame:
    """``row`` (the input row, or its ``carry`` columns) and ``score``, from the whole text alone.

    Null and empty texts get the score of an empty text; repeated rows get equal scores; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = boxed_texts(docs, text, carry)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.scores(texts_in(batch, text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["row", "score"])

    return map_batches(source, StructType().add(source.schema["row"]).add("score", DoubleType()), work, TEXT_ROWS)


def accepted() -> Column:
    return F.col("score") >= THRESHOLD


def held_out(key: Column) -> Column:
    return fold(key, FOLDS) == HELD_OUT
