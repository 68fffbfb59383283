"""Early stopping over metric logs, and the choice of the best epoch or trial. Many runs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayloom.operators.ordered import join_null_safe, running, running_best
from assayloom.staging import stage

#: Running maxima that one run may hold in one row; longer runs are followed by joins.
HELD_RECORDS = 10_000


def _log(logs: DataFrame, run: str, order: list[str], metric: str, larger_is_better: bool) -> DataFrame:
    """Run, order and the metric turned so that larger is better; NaN becomes null, which never improves."""
    signed = F.col(metric) if larger_is_better else -F.col(metric)
    value = F.when(~F.isnan(signed), signed).cast("double")
    return logs.select(run, *order, value.alias("_value"), F.lit(1).cast("long").alias("_one"))


def improvements(
    log: DataFrame, run: str, order: list[str], gap: float, most_epochs: int | None, held_records: int
) -> DataFrame:
    """``run, epoch, value`` of the epochs that beat the best so far by more than ``gap``; epochs count from 1.

    With a gap the best so far is not the running maximum. But an epoch that improves by more than the gap is always a
    strict running maximum too, so only those are looked at. A run with up to ``held_records`` of them is folded in its row. In
    a longer one each points to the first later one above its value plus the gap, and the chain from the first is followed by
    doubling: as many joins as its length has binary digits, and no run has to fit a task.
    """
    outputs = {"epoch": ("sum", "_one"), "_best": ("max_before", "_value")}
    seen = running(log, [run], order, outputs)
    if most_epochs is not None:
        seen = seen.where(F.col("epoch") <= most_epochs)
    higher = F.col("_best").isNull() | (F.col("_value") > F.col("_best"))
    records = seen.where(F.col("_value").isNotNull() & higher).select(run, "epoch", F.col("_value").alias("value"))
    records = stage(records, "running-maxima")
    sizes = records.groupBy(run).agg((F.count(F.lit(1)) > held_records).alias("_long"))
    sized = join_null_safe(records, sizes, [run])
    short = _folded(sized.where(~F.col("_long")).drop("_long"), run, gap)
    # Most logs have no long run; following none would only cost its joins.
    if not sizes.where("_long").limit(1).count():
        return short
    return short.unionByName(_followed(stage(sized.where("_long").drop("_long"), "long-runs"), run, gap))


def _folded(records: DataFrame, run: str, gap: float) -> DataFrame:
    step = F.struct("epoch", "value")
    held = records.groupBy(run).agg(F.array_sort(F.collect_list(step)).alias("_held"))
    none = F.array().cast("array<struct<epoch:bigint,value:double>>")

    def kept(sofar: Column, record: Column) -> Column:
        better = (F.size(sofar) == 0) | (record["value"] > F.element_at(sofar, -1)["value"] + gap)
        return F.when(better, F.array_append(sofar, record)).otherwise(sofar)

    return held.select(run, F.inline(F.aggregate("_held", none, kept)))


def _followed(records: DataFrame, run: str, gap: float) -> DataFrame:
    # Records and, a gap higher, the question of each; from the top down, the earliest record so far is the answer. On equal
    # values the question comes first, since the answer has to be above it.
    is_record = records.select(run, F.col("value").alias("_at"), F.lit(0).alias("_asks"), "epoch", (-F.col("epoch")).alias("_back"))
    asks = records.select(run, (F.col("value") + gap).alias("_at"), F.lit(1).alias("_asks"), "epoch", F.lit(None).cast("long").alias("_back"))
    answered = running(is_record.unionByName(asks), [run], ["-_at", "-_asks", "epoch"], {"_next": ("max", "_back")})
    jumps = answered.where("_asks = 1 and _next is not null").select(run, "epoch", (-F.col("_next")).alias("_to"))
    jumps = stage(jumps, "jumps")
    reached = stage(records.groupBy(run).agg(F.min("epoch").alias("epoch")), "reached")
    before, after = -1, reached.count()
    while before < after:
        ahead = join_null_safe(reached, jumps, [run, "epoch"]).select(run, F.col("_to").alias("epoch"))
        reached = stage(reached.unionByName(ahead).distinct(), "reached")
        further = jumps.select(run, F.col("epoch").alias("_to"), F.col("_to").alias("_last"))
        jumps = stage(join_null_safe(jumps, further, [run, "_to"]).select(run, "epoch", F.col("_last").alias("_to")), "jumps")
        before, after = after, reached.count()
    return join_null_safe(records, reached, [run, "epoch"])


def early_stops(
    logs: DataFrame,
    run: str,
    order: list[str],
    metric: str,
    patience: int = 10,
    gap: float = 1e-4,
    larger_is_better: bool = True,
    most_epochs: int | None = None,
    held_records: int = HELD_RECORDS,
) -> DataFrame:
    """``run, epochs, best_epoch, best_value, stop_epoch`` of each run under a patience rule.

    A run stops at the epoch that is the ``patience``-th in a row without an improvement by more than ``gap``, and nothing
    after it counts. Rows without a run are a run. ``stop_epoch`` is null for a run that ends before that. ``most_epochs`` is the trainer's own limit.
    """
    log = _log(logs, run, order, metric, larger_is_better)
    if gap > 0:
        found = _stops_with_gap(log, run, order, patience, gap, most_epochs, held_records)
    else:
        found = _stops_without_gap(log, run, order, patience, most_epochs)
    value = F.col("_at.value") if larger_is_better else -F.col("_at.value")
    return found.select(
        run,
        "epochs",
        F.when(F.col("_at.epoch") > 0, F.col("_at.epoch")).alias("best_epoch"),
        value.alias("best_value"),
        "stop_epoch",
    )


def _stops_without_gap(
    log: DataFrame, run: str, order: list[str], patience: int, most_epochs: int | None
) -> DataFrame:
    """Running maxima and one aggregate: no run has to fit one task."""
    # The best value so far at its first epoch is the last improvement.
    rows = running_best(log, [run], order, "_value").withColumn("epoch", F.col("row"))
    if most_epochs is not None:
        rows = rows.where(F.col("epoch") <= most_epochs)
    last = F.coalesce(-F.col("best.back"), F.lit(0))
    at = F.struct(last.alias("epoch"), F.col("best.value").alias("value"))
    here = F.struct(F.col("epoch").alias("now"), at.alias("at"))
    merged = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("epochs"),
        F.min(F.when(F.col("epoch") - last >= patience, here)).alias("_stopped"),
        F.max(here).alias("_last"),
    )
    return merged.select(
        run, "epochs", F.coalesce("_stopped.at", "_last.at").alias("_at"), F.col("_stopped.now").alias("stop_epoch")
    )


def _stops_with_gap(
    log: DataFrame, run: str, order: list[str], patience: int, gap: float, most_epochs: int | None, held_records: int
) -> DataFrame:
    found = improvements(log, run, order, gap, most_epochs, held_records)
    lengths = log.groupBy(run).agg(F.count(F.lit(1)).alias("epochs"))
    if most_epochs is not None:
        lengths = lengths.withColumn("epochs", F.least("epochs", F.lit(most_epochs).cast("long")))
    starts = lengths.select(run, F.lit(0).cast("long").alias("epoch"), F.lit(None).cast("double").alias("value"))
    following = F.lead("epoch").over(Window.partitionBy(run).orderBy("epoch"))
    steps = join_null_safe(starts.unionByName(found).withColumn("_next", following), lengths, [run])
    stop = F.col("epoch") + patience
    stops = (F.col("_next").isNull() | (F.col("_next") > stop)) & (stop <= F.col("epochs"))
    merged = steps.groupBy(run).agg(
        F.max("epochs").alias("epochs"),
        F.min(F.when(stops, stop)).alias("stop_epoch"),
        F.min(F.when(stops, F.struct("epoch", "value"))).alias("_stopped"),
        F.max(F.struct("epoch", "value")).alias("_last"),
    )
    return merged.select(run, "epochs", F.coalesce("_stopped", "_last").alias("_at"), "stop_epoch")


def best_epochs(logs: DataFrame, run: str, epoch: str, metric: str, larger_is_better: bool = False) -> DataFrame:
    """``run, best_epoch, best_metric``: the best epoch of each run, the earliest among equals."""
    return best_rows(logs, [run], epoch, metric, larger_is_better).select(
        run, F.col(epoch).alias("best_epoch"), F.col(metric).alias("best_metric")
    )


def best_rows(
    df: DataFrame, keys: list[str], number: str, score: str, larger_is_better: bool = False
) -> DataFrame:
    """The row with the best score per key, the lowest ``number`` among equals. Missing scores never win."""
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    signed = -F.col(score) if larger_is_better else F.col(score)
    whole = F.struct(*[c for c in df.columns if c not in keys])
    best = scored.groupBy(*keys).agg(F.min_by(whole, F.struct(signed, F.col(number))).alias("_best"))
    return best.select(*keys, "_best.*")


def best_trial(trials: DataFrame, larger_is_better: bool = False) -> DataFrame:
    """The winning row of a trial ledger ``trial, params, score``."""
    return best_rows(trials, [], "trial", "score", larger_is_better)
