"""Trials and intervals: pairing of event markers, stimulus runs, and stamping samples with the interval they are in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import anyof, changed, finite, ordered, run_id


def event_matches(name: str | Column, patterns: Sequence[str]) -> Column:
    """Equal to a pattern, or found by it as a regular expression without regard to case."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(anyof([(c == p) | c.rlike(f"(?i){p}") for p in patterns]), F.lit(False))


def build_trials(events: DataFrame, time: str, by: Sequence[str], name: str = "event_name", start: Sequence[str] = ("TRIAL_START",), end: Sequence[str] = ("TRIAL_END",), unmatched: str = "drop") -> DataFrame:
    """An interval for each start marker, to the first end marker before the next start.

    A start without an end is dropped, or ends with the next start or the group's last event."""
    t = finite(time)
    flags = events.select(*by, t.alias("_t"), event_matches(name, start).alias("_s"), event_matches(name, end).alias("_e")).filter("_t is not null")
    w = Window.partitionBy(*by).orderBy("_t")
    after = w.rangeBetween(Window.currentRow, Window.unboundedFollowing)
    seen = flags.withColumns({"_end": F.min(F.when(F.col("_e"), F.col("_t"))).over(after), "_last": F.max("_t").over(Window.partitionBy(*by))})
    starts = seen.filter("_s").withColumn("_next", F.lead("_t").over(ordered(by, "_t")))
    end_at = F.when(F.col("_end") <= F.coalesce("_next", "_end"), F.col("_end"))
    spare = {"drop": F.lit(None).cast("double"), "next_start": F.coalesce("_next", "_last"), "recording_end": F.col("_last")}[unmatched]
    numbered = starts.withColumn("trial_index", F.row_number().over(ordered(by, "_t")))
    return numbered.select(*by, "trial_index", F.col("_t").alias("start_time"), F.coalesce(end_at, spare).alias("end_time")).filter("end_time is not null")


def build_stimulus_intervals(df: DataFrame, time: str, by: Sequence[str], stimulus: str) -> DataFrame:
    """Runs of one stimulus, with first and last time."""
    w = ordered(by, time)
    runs = df.withColumn("_run", run_id(changed(stimulus, w), w)).filter(F.col(stimulus).isNotNull())
    return runs.groupBy(*by, "_run", stimulus).agg(F.min(finite(time)).alias("start_time"), F.max(finite(time)).alias("end_time"), F.count("*").alias("n_samples")).drop("_run")


def interval_join(points: DataFrame, intervals: DataFrame, time: str, by: Sequence[str], width: float, start: str = "start_time", end: str = "end_time", keep: Sequence[str] = ()) -> DataFrame:
    """Points joined with every closed interval of their group that holds them; columns keep of the interval.

    Intervals are listed in the time bins of ``width`` that they touch, so that the join is an equi-join on group and bin."""
    names = {start: "_from", end: "_to"}
    cut = intervals.select(*by, F.col(start).alias("_from"), F.col(end).alias("_to"), *(c for c in keep if c not in names)).filter("_from <= _to")
    binned = cut.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))))
    placed = points.withColumn("_bin", F.floor(finite(time) / width))
    return placed.join(binned, [*by, "_bin"]).filter(finite(time).between(F.col("_from"), F.col("_to"))).drop("_bin")


def assign_trials(samples: DataFrame, intervals: DataFrame, time: str, by: Sequence[str], key: str, trial: str, order: str, width: float) -> DataFrame:
    """Samples with the trial of the first interval, by order, that holds them; null where none does. key identifies a sample within its group."""
    held = interval_join(samples.select(*by, key, time), intervals, time, by, width, keep=[trial, order])
    first = held.groupBy(*by, key).agg(F.min_by(trial, order).alias(trial))
    return samples.join(first, [*by, key], "left")


def add_responses(responses: DataFrame, new: DataFrame, keys: Sequence[str] = ("participant_id", "item_id", "trial_id")) -> DataFrame:
    """responses, with rows replaced where new has their keys, and new rows."""
    return responses.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def build_item_responses(intervals: DataFrame, score_key: DataFrame | None = None) -> DataFrame:
    """A response row a trial; response time is the interval's length."""
    rows = intervals.withColumn("response_time", F.col("end_time") - F.col("start_time"))
    return rows.join(score_key, "item_id", "left") if score_key is not None else rows


def audit_trial_coverage(intervals: DataFrame, tables: dict[str, DataFrame], by: Sequence[str]) -> DataFrame:
    """Rows that each table has for each trial."""
    out = intervals.select(*by).distinct()
    for name, table in tables.items():
        out = out.join(table.groupBy(*by).agg(F.count("*").alias(f"n_{name}")), list(by), "left")
    return out.fillna(0, [f"n_{n}" for n in tables])
