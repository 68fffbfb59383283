"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reported speech, other). Small transducers read a clause's symbols:
each remembers one thing (a negation a few words back, a target, a reporting verb), and their product is the grammar. Where an
insult or a threat is read, the product's state says what kind of match it is. A document's score is a logistic function of
its matches, with the weights of the kinds fitted to labels around stated prior weights.

The insult lexicon has a stated part and a learned part: words that a good share of the distinct training texts labelled toxic
have and clean ones do not. Rarer words of that kind are only *markers*: a document has to have several of them, as variants of
a text that was labelled toxic do. Texts that share their smallest word hash count once, so copies cannot teach a word.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from assayloom.llm.labelled import fold, training_rows
from assayloom.llm.rows import TEXT_ROWS, boxed_texts, map_batches, texts_in

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Lexicon and weights are fitted on at most this many labelled documents.
MOST_TRAINING_ROWS = 8_192
#: A learned word or marker has this many of the distinct toxic texts, a word also this share of them, and this log-odds.
LEAST_TEXTS = 8
LEAST_SHARE = 0.1
LEAST_LOG_ODDS = 2.5
#: This many different markers in a document are chance.
IDLE_MARKERS = 2
#: Words that a negation reaches.
NEGATION_REACH = 3

# The stated lexicon, by symbol.
LEXICON = {
    "insult": "idiot idiots moron morons imbecile scum trash loser losers stupid disgusting pathetic worthless clown "
    "dumb filth vermin abschaum idioten ordures salaud connard idiota imbécil basura escoria dummkopf",
    "threat": "kill hurt destroy shoot stab beat murder töten umbringen tuer frapper matar golpear",
    "target": "you your yours he she him her they them their du dich dir euch ihr sie tu toi te vous il elle ils eux usted "
    "ustedes tú él ella ellos",
    "negation": "not no never none hardly isn aren don nicht kein keine nie ne pas jamais nunca jamás",
    "report": "said says say called calls wrote told claimed quoted sagte sagt nannte dit disait appelé dijo dice llamó",
}
SYMBOLS = ("other", *LEXICON)
#: What a clause can match, with the prior weight of each.
MATCHES = {
    "insult": 3.0,
    "directed_insult": 3.5,
    "negated_insult": 1.0,
    "reported_insult": 1.0,
    "threat": 0.5,
    "directed_threat": 1.5,
    "negated_threat": -0.5,
    "reported_threat": -0.5,
    "marker": 0.0,
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_FOLD = {ord("A") + i: ord("a") + i for i in range(26)}


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_FOLD)


@dataclass(frozen=True)
class Transducer:
    """States 0..n-1 from 0; ``step[state][symbol]`` is the next state, ``mark[state]`` what it says about the next word."""

    step: tuple[tuple[int, ...], ...]
    mark: tuple[frozenset, ...]


def counter(trigger: str, reach: int, mark: str) -> Transducer:
    """Says ``mark`` about the ``reach`` words after a trigger."""
    rows = []
    for state in range(reach + 1):
        rows.append(tuple(reach if s == trigger else max(state - 1, 0) for s in SYMBOLS))
    return Transducer(tuple(rows), tuple(frozenset([mark] if s else []) for s in range(reach + 1)))


def latch(trigger: str, mark: str) -> Transducer:
    """Says ``mark`` about every word of the clause after a trigger."""
    rows = tuple(tuple(1 if state or s == trigger else 0 for s in SYMBOLS) for state in (0, 1))
    return Transducer(rows, (frozenset(), frozenset([mark])))


def composed(one: Transducer, other: Transducer) -> Transducer:
    """The product: both read the same symbols, and their marks come together."""
    width = len(other.mark)
    step = tuple(
        tuple(a[s] * width + b[s] for s in range(len(SYMBOLS))) for a in one.step for b in other.step
    )
    return Transducer(step, tuple(a | b for a in one.mark for b in other.mark))


def grammar() -> Transducer:
    whole_ = counter("negation", NEGATION_REACH, "negated")
    for part in (latch("report", "reported"), latch("target", "directed")):
        whole_ = composed(whole_, part)
    return whole_


GRAMMAR = grammar()
_INSULT, _THREAT, _TARGET = (SYMBOLS.index(s) for s in ("insult", "threat", "target"))


def clause_matches(symbols: Sequence[int]) -> Iterator[str]:
    """Names of the matches of one clause, in order. A target after an insult or threat directs it too."""
    state, later = 0, [False] * (len(symbols) + 1)
    for i in range(len(symbols) - 1, -1, -1):
        later[i] = later[i + 1] or symbols[i] == _TARGET
    for i, symbol in enumerate(symbols):
        if symbol in (_INSULT, _THREAT):
            said = GRAMMAR.mark[state]
            kind = SYMBOLS[symbol]
            if "negated" in said:
                yield f"negated_{kind}"
            elif "reported" in said:
                yield f"reported_{kind}"
            elif "directed" in said or later[i + 1]:
                yield f"directed_{kind}"
            else:
                yield kind
        state = GRAMMAR.step[state][symbol]


def lexicon_of(learned: Iterable[str] = ()) -> dict[str, int]:
    """Word to symbol; a learned word is an insult unless it is stated otherwise."""
    out = dict.fromkeys(learned, _INSULT)
    for name, words in LEXICON.items():
        out.update(dict.fromkeys(words.split(), SYMBOLS.index(name)))
    return out


@dataclass
class Grammar:
    """A lexicon with the weights of what its matches mean."""

    lexicon: Mapping[str, int]
    markers: frozenset[str]
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.triggers = {w for w, s in self.lexicon.items() if s in (_INSULT, _THREAT)}

    def matches(self, text: str) -> list[tuple[str, str]]:
        """(match, clause) for every matched clause of the whole text."""
        low = lowered(text)
        own = set(_WORD.findall(low))
        out = [("marker", w) for w in sorted(self.markers & own)[IDLE_MARKERS:]]
        if self.triggers.isdisjoint(own):
            return out
        for clause in _CLAUSE.split(low):
            words = _WORD.findall(clause)
            if not self.triggers.isdisjoint(words):
                out += [(m, clause) for m in clause_matches([self.lexicon.get(w, 0) for w in words])]
        return out

    def score(self, matches: Sequence[tuple[str, str]]) -> float:
        margin = self.bias + float(self.weights @ vector(matches))
        return 1 / (1 + math.exp(-min(max(margin, -30), 30)))


def vector(matches: Sequence[tuple[str, str]]) -> np.ndarray:
    """Per kind of match 1 for the first and less for each more."""
    counts = Counter(m for m, _ in matches)
    return np.array([math.log2(1 + counts[m]) for m in MATCHES])


def learned_words(texts: Sequence[str], labels: Sequence[int]) -> tuple[list[str], frozenset[str]]:
    """Words of many distinct toxic texts and of hardly any clean one, and markers."""
    seen: tuple[dict, dict] = ({}, {})
    groups: tuple[set, set] = (set(), set())
    for text, label in zip(texts, labels):
        words = set(_WORD.findall(lowered(text)))
        if words:
            group = min(zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words)
            groups[label].add(group)
            for word in words:
                seen[label].setdefault(word, set()).add(group)
    toxic, clean = len(groups[1]) + 1, len(groups[0]) + 1
    words, markers = [], set()
    for word, having in seen[1].items():
        if len(having) >= LEAST_TEXTS:
            odds = math.log((len(having) + 0.5) / toxic) - math.log((len(seen[0].get(word, ())) + 0.5) / clean)
            if odds >= LEAST_LOG_ODDS:
                words.append(word) if len(having) >= LEAST_SHARE * toxic else markers.add(word)
    return sorted(words), frozenset(markers)


def fit(texts: Sequence[str], labels: Sequence[int]) -> Grammar:
    """Learned words, then weights by Newton steps around the prior ones. Without rows the prior holds."""
    prior = np.array(list(MATCHES.values()))
    words, markers = learned_words(texts, labels)
    model = Grammar(lexicon_of(words), markers, prior, -3.0)
    if not len(texts):
        return model
    rows = np.array([np.append(vector(model.matches(t)), 1.0) for t in texts])
    truth, start = np.array(labels, float), np.append(prior, -3.0)
    pull = np.append(np.full(len(prior), 1.0), 1e-3)
    at = start.copy()
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(rows @ at, -30, 30)))
        slope = rows.T @ (chance - truth) + pull * (at - start)
        bend = (rows * (chance * (1 - chance))[:, None]).T @ rows + np.diag(pull)
        at = at - np.linalg.solve(bend, slope)
    model.weights, model.bias = at[:-1], float(at[-1])
    return model


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_TRAINING_ROWS) -> Grammar:
    """Fitted on the labelled rows outside the held-out fold, ``most`` at the most."""
    rows = training_rows(docs, labels, label, FOLDS, HELD_OUT, most).orderBy("key").toPandas()
    return fit(rows["text"].tolist(), rows["label"].tolist())


def score_toxicity(
    docs: DataFrame, model: Grammar, text: str = "text", carry: Sequence[str] | None = None, clauses: bool = True
) -> DataFrame:
    """``row`` (the input row, or its ``carry`` columns), ``score`` and, with ``clauses``, the matched ``clauses``.

    Whole texts are read. Null and empty texts match nothing and get the score of that; repeated rows get equal scores; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = boxed_texts(docs, text, carry)
    match = StructType().add("match", StringType()).add("clause", StringType())
    schema = StructType().add(source.schema["row"]).add("score", DoubleType())
    kind = pa.list_(pa.struct([("match", pa.string()), ("clause", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.matches(t) for t in texts_in(batch, text)]
            arrays = [batch.column(0), pa.array([shared.value.score(m) for m in found], pa.float64())]
            if clauses:
                arrays.append(pa.array([[{"match": m, "clause": c} for m, c in row] for row in found], kind))
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "score", "clauses"][: len(arrays)])

    return map_batches(source, schema.add("clauses", ArrayType(match)) if clauses else schema, work, TEXT_ROWS)


def held_out(key: Column) -> Column:
    return fold(key, FOLDS) == HELD_OUT
