"""Personal data by fixed patterns, and more of it by bootstrapped contexts.

Base spans come from patterns with checks. They are the seeds: a token with a digit that overlaps one is an *instance* of its
kind, and so is a long hexadecimal token of the kind ``secret``. The words and the mark in front of an instance are its
*patterns*. The pattern-instance graph is scored in rounds: a pattern is as good as the share of its instances that are of one
kind, an instance is as good as its patterns. Patterns with many distinct instances and a high score then mark tokens that no
base pattern finds.

All of it is built-in functions. A document's spans are found inside its row; the graph is keyed by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.llm.rows import LOWER, UPPER, boxed, text_of
from assayloom.staging import stage

KINDS = ("email", "ip", "card", "phone", "secret")
ROUNDS = 3
#: A pattern counts from this many distinct instances of a kind, and marks new tokens from this score.
LEAST_INSTANCES = 10
LEAST_SCORE = 0.9
#: Code points in front of a token that its context words may come from.
CONTEXT_CHARS = 80

# The base patterns. Possessive and anchored to the start of a run, or to the end of the last match, so that no text is
# walked through twice; they find what the plain patterns find.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_SECRET = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"
_BLOCK = 256


def spans_of(df: DataFrame, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """Adds per pattern ``array<struct<start, stop, match, before>>`` of leftmost non-overlapping matches, in code points.

    ``before`` is the end of the gap in front. Matches and gaps are columns of their own, so each is found once per row. Running
    sums go by blocks, so that many matches in one text stay cheap.
    """
    found = df.withColumns({f"{n}_found": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for n, p in patterns.items()})
    cut = found.withColumns(
        {
            f"{n}_gaps": F.when(F.size(f"{n}_found") > 0, F.split(text, p, -1)).otherwise(F.array().cast("array<string>"))
            for n, p in patterns.items()
        }
    )
    steps = cut.withColumns(
        {
            f"{n}_steps": F.transform(
                F.arrays_zip(F.slice(f"{n}_gaps", 1, F.size(f"{n}_found")).alias("gap"), F.col(f"{n}_found").alias("match")),
                lambda x: F.struct(F.length(x["gap"]).cast("long").alias("gap"), F.length(x["match"]).cast("long").alias("size")),
            )
            for n in patterns
        }
    )
    placed = steps.withColumns({f"{n}_starts": _starts(f"{n}_steps") for n in patterns})
    return placed.withColumns({n: _described(f"{n}_starts", f"{n}_found", f"{n}_gaps") for n in patterns})


def _starts(steps: str) -> Column:
    """Starts of the matches: running sums within blocks, on top of running sums of the blocks."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(steps) / _BLOCK).cast("int")), lambda b: F.slice(steps, b * _BLOCK + 1, _BLOCK)
    )
    zero = lambda at: F.struct(at.alias("at"), F.array().cast("array<long>").alias("out"))
    running = lambda block, at: F.aggregate(
        block,
        zero(at),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"), F.array_append(acc["out"], acc["at"] + x["gap"]).alias("out")
        ),
    )
    done = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<long>>").alias("out")),
        lambda acc, block: F.transform(
            F.array(running(block, acc["at"])),
            lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out")),
        )[0],
    )
    return F.when(F.size(steps) > 0, F.flatten(done["out"])).otherwise(F.array().cast("array<long>"))


def _described(starts: str, found: str, gaps: str) -> Column:
    return F.transform(
        F.arrays_zip(F.col(starts).alias("start"), F.col(found).alias("match"), F.slice(gaps, 1, F.size(found)).alias("gap")),
        lambda x: F.struct(
            x["start"].alias("start"),
            (x["start"] + F.length(x["match"])).alias("stop"),
            x["match"].alias("match"),
            F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"),
        ),
    )


def valid_ip(match: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    fits = lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(match, r"\."), fits)


def valid_card(match: Column) -> Column:
    digits = F.regexp_replace(match, r"[\x20-]", "")
    size = F.length(digits)

    def value(place: Column) -> Column:
        digit = F.substring(digits, size - place + 1, F.lit(1)).cast("int")
        return F.when(place % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    luhn = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda a, i: a + value(i))
    return F.when(size.between(13, 19), luhn % 10 == 0).otherwise(False)


def valid_phone(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)


_CHECKS = {"ip": valid_ip, "card": valid_card, "phone": valid_phone}
_PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}


def valid_spans(kind: str) -> Column:
    """The matches of a base kind that pass its check, in order of their starts."""
    check = _CHECKS.get(kind)
    return F.filter(kind, lambda s: check(s["match"])) if check else F.col(kind)


def base_spans() -> Column:
    """``array<struct<rank, start, stop>>`` of the four base kinds, by kind and start, from columns ``valid_`` and the kind."""

    def of_kind(kind: str) -> Column:
        rank = F.lit(KINDS.index(kind))
        return F.transform(f"valid_{kind}", lambda s: F.struct(rank.alias("rank"), s["start"].alias("start"), s["stop"].alias("stop")))

    return F.concat(*map(of_kind, _PATTERNS))


def _overlapped(spans: Column, start: Column, stop: Column) -> Column:
    """Whether a place meets one of the spans, which don't overlap and are in order: halving finds the last that begins before its end."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def halve(span: Column, _: Column) -> Column:
        middle = F.shiftright(span["low"] + span["high"] + 1, 1)
        begins = F.get(spans, middle)["start"] < stop
        return F.struct(
            F.when(begins, middle).otherwise(span["low"]).alias("low"), F.when(begins, span["high"]).otherwise(middle - 1).alias("high")
        )

    whole = F.struct(F.lit(-1).alias("low"), (F.size(spans) - 1).alias("high"))
    last = F.aggregate(steps, whole, halve, lambda span: F.get(spans, span["low"])["stop"])
    return F.when(F.size(spans) > 0, F.coalesce(last > start, F.lit(False))).otherwise(False)


def candidate_tokens() -> Column:
    """Tokens with a digit and six or more characters, trimmed of marks, with their contexts and the kind they are known as."""

    def described(s: Column) -> Column:
        opening = F.regexp_extract(s["match"], r"^[^A-Za-z0-9+]*", 0)
        inner = F.regexp_replace(s["match"], r"^[^A-Za-z0-9+]+|[^A-Za-z0-9]+$", "")
        start = s["start"] + F.length(opening)
        stop = start + F.length(inner)
        words = F.regexp_replace(F.translate(s["before"], UPPER, LOWER), "[0-9]", "0")
        two = F.regexp_extract(words, r"(\S++)\s++(\S++)\s++$", 1)
        one = F.regexp_extract(words, r"(\S++)\s++$", 1)
        mark = F.right(opening, F.lit(4))
        met = [F.when(_overlapped(F.col(f"valid_{k}"), start, stop), F.lit(KINDS.index(k))) for k in _PATTERNS]
        known = F.coalesce(*met)
        return F.struct(
            start.alias("start"),
            stop.alias("stop"),
            F.xxhash64(inner).alias("instance"),
            F.length(inner).alias("size"),
            known.isNotNull().alias("in_base"),
            F.coalesce(known, F.when(inner.rlike(_SECRET), F.lit(KINDS.index("secret")))).alias("rank"),
            F.filter(
                F.array(
                    F.when(one != "", F.xxhash64(F.lit(1), one, mark)), F.when(two != "", F.xxhash64(F.lit(2), two, one, mark))
                ),
                lambda p: p.isNotNull(),
            ).alias("patterns"),
        )

    return F.filter(F.transform("token", described), lambda c: c["size"] >= 6)


def _names(prefix: str) -> list[str]:
    return [f"{prefix}_{k}" for k in KINDS]


def pattern_scores(tokens: DataFrame, rounds: int = ROUNDS, least_instances: int = LEAST_INSTANCES) -> DataFrame:
    """``pattern`` with a score per kind (``s_email`` ...), for patterns with enough instances of some kind."""
    edges = stage(tokens.select(F.explode("patterns").alias("pattern"), "instance").distinct(), "context-edges")
    seeds = tokens.where(F.col("rank").isNotNull()).groupBy("instance")
    seeds = seeds.agg(*[F.max((F.col("rank") == i).cast("double")).alias(f"c_{k}") for i, k in enumerate(KINDS)])
    seeds = stage(seeds, "context-seeds")
    confidence, patterns = seeds, None
    for _ in range(rounds):
        known = edges.join(confidence, "instance", "left")
        sums = known.groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.coalesce(f"c_{k}", F.lit(0.0))).alias(f"t_{k}") for k in KINDS],
            *[F.sum((F.coalesce(f"c_{k}", F.lit(0.0)) >= 0.5).cast("long")).alias(f"n_{k}") for k in KINDS],
        )
        scores = [
            F.when(F.col(f"n_{k}") >= least_instances, F.round(F.col(f"t_{k}") / (F.col("n") + 1), 9)).otherwise(0.0).alias(f"s_{k}")
            for k in KINDS
        ]
        patterns = sums.select("pattern", *scores).where(F.greatest(*_names("s")) > 0)
        patterns = stage(patterns, "context-patterns")
        doubt = lambda k: F.sum(F.log1p(-F.least(F.col(f"s_{k}"), F.lit(1 - 1e-9))))
        reached = edges.join(patterns, "pattern").groupBy("instance").agg(*[(-F.expm1(doubt(k))).alias(f"r_{k}") for k in KINDS])
        both = seeds.withColumn("seed", F.lit(True)).join(reached, "instance", "full")
        kept = [F.when(F.col("seed"), F.col(f"c_{k}")).otherwise(F.col(f"r_{k}")).alias(f"c_{k}") for k in KINDS]
        confidence = stage(both.select("instance", *kept), "context-instances")
    return patterns


def find_personal_data(
    docs: DataFrame, text: str = "text", rounds: int = ROUNDS, carry: Sequence[str] | None = None
) -> DataFrame:
    """``row`` (the input row, or its ``carry`` columns), ``base`` and ``spans``: arrays of (rank of the kind, start, stop), sorted.

    ``spans`` has the base spans and what confident contexts add; added tokens never overlap a base span. Null and empty texts
    have no spans; repeated rows get the same spans; an empty table gives an empty result. Equal contexts across the whole
    corpus are counted once per distinct instance, so copies of a document do not make a pattern better.
    """
    source = boxed(docs, carry, text=text_of(f"`{text}`"))
    found = spans_of(source, "text", _PATTERNS | {"token": _TOKEN})
    found = found.withColumns({f"valid_{k}": valid_spans(k) for k in _PATTERNS})
    found = found.withColumns({"base": base_spans(), "tokens": candidate_tokens()})
    found = stage(found.select("row", F.xxhash64("text", F.length("text")).alias("place"), "base", "tokens"), "personal-data")
    tokens = found.where(F.size("tokens") > 0).select("place", F.explode("tokens").alias("t")).select("place", "t.*")
    patterns = pattern_scores(tokens, rounds).where(F.greatest(*_names("s")) >= LEAST_SCORE)
    open_tokens = tokens.where(~F.col("in_base")).select("place", "start", "stop", F.explode("patterns").alias("pattern"))
    best = reduce(
        lambda rest, i: F.when(F.col(f"s_{KINDS[i]}") == F.greatest(*_names("s")), F.lit(i)).otherwise(rest),
        reversed(range(len(KINDS))),
        F.lit(None).cast("int"),
    )
    marked = open_tokens.join(patterns, "pattern").select(
        "place", "start", "stop", F.struct(F.greatest(*_names("s")).alias("score"), (-best).alias("order"), best.alias("rank")).alias("m")
    )
    added = marked.groupBy("place", "start", "stop").agg(F.max("m").alias("m"))
    added = added.groupBy("place").agg(F.collect_set(F.struct(F.col("m.rank").alias("rank"), "start", "stop")).alias("added"))
    joined = found.select("row", "place", "base").join(stage(added, "personal-data-added"), "place", "left")
    none = F.array().cast("array<struct<rank:int,start:long,stop:long>>")
    return joined.select("row", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["stop"])))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")
