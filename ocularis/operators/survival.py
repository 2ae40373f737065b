"""Latencies with censoring: preparation, Kaplan-Meier curves and quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, normal_quantile, ratio, share
from ..functions.ranks import bucketed, run_through
from ..functions.rounds import Table


def prepare_gaze_survival_data(trials: DataFrame, events: DataFrame, by: Sequence[str], trial_start: str, trial_end: str, event_time: str, valid: str | None = None) -> DataFrame:
    """A row a trial with the latency of its first event in the closed trial, or its length as the censoring time.

    Invalid trials, and those without a positive length, are for review and never censored."""
    hits = trials.select(*by, trial_start, trial_end).join(events.select(*by, finite(event_time).alias("_t")), list(by))
    first = hits.filter(F.col("_t").between(F.col(trial_start), F.col(trial_end))).groupBy(*by).agg(F.min("_t").alias("_first"))
    joined = trials.join(first, list(by), "left")
    length = finite(trial_end) - finite(trial_start)
    review = ~(F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(True)) | F.coalesce(length <= 0, F.lit(True))
    seen = F.col("_first").isNotNull()
    return joined.withColumns(
        {
            "event_time": F.when(~review & seen, F.col("_first") - F.col(trial_start)),
            "censor_time": F.when(~review, length),
            "event_observed": F.when(~review, seen),
            "censoring_reason": F.when(review, "review").when(seen, "event").otherwise("trial_end"),
        }
    ).withColumn("analysis_time", F.coalesce("event_time", "censor_time")).drop("_first")


def summarise_gaze_censoring(data: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return data.groupBy(*by).agg(F.count("*").alias("n_trials"), F.count_if("event_observed").alias("n_events"), F.count_if(~F.col("event_observed")).alias("n_censored"), F.count_if(F.col("event_observed").isNull()).alias("n_review"), (1 - share(F.coalesce("event_observed", F.lit(False)))).alias("censoring_fraction"))


def estimate_gaze_survival(data: DataFrame, by: Sequence[str] = (), time: str = "analysis_time", event: str = "event_observed", level: float = 0.95) -> DataFrame:
    """Kaplan-Meier curve at each event time with Greenwood's standard error and a normal interval.

    Times are counted first, into a work table; those at risk and the running sums are made in one pass over buckets of equal depth, so that no window holds a whole group. Where all at risk have their event the curve is zero."""
    rows = data.select(*by, finite(time).alias("time"), F.col(event).alias("_e")).filter("time is not null and _e is not null")
    counts = Table(rows.groupBy(*by, "time").agg(F.count("*").alias("_n"), F.count_if("_e").alias("n_events")), "survival-times").df
    d, n = F.col("n_events"), F.col("n_at_risk")
    sums = {"_l": (F.sum, F.when(d < n, F.ln(1 - d / n)).otherwise(0.0)), "_g": (F.sum, F.coalesce(ratio(d, n * (n - d)), F.lit(0.0)))}
    curve = run_through(bucketed(counts, "time", by), "time", [{"n_at_risk": (F.sum, F.col("_n"), True)}, sums], by)
    curve = curve.withColumn("survival", F.when(d == n, 0.0).otherwise(F.exp("_l"))).filter("n_events > 0")
    z = normal_quantile(0.5 + level / 2)
    se = F.col("survival") * F.sqrt("_g")
    return curve.withColumn("std_error", se).select(*by, "time", "n_at_risk", "n_events", "survival", "std_error", F.greatest(F.lit(0.0), F.col("survival") - z * F.col("std_error")).alias("lower"), F.least(F.lit(1.0), F.col("survival") + z * F.col("std_error")).alias("upper"))


def estimate_gaze_latency_quantiles(curve: DataFrame, probabilities: Sequence[float] = (0.25, 0.5, 0.75), by: Sequence[str] = ()) -> DataFrame:
    """First time at which the curve is at or below 1 - p; null if it never is."""
    return curve.groupBy(*by).agg(*(F.min(F.when(F.col("survival") <= 1 - p + 1e-12, F.col("time"))).alias(f"q{round(100 * p)}") for p in probabilities))


def cause_specific_hazards(data: DataFrame, by: Sequence[str], time: str, cause: str) -> DataFrame:
    """Exponential hazard of each cause: events over exposure."""
    exposure = data.groupBy(*by).agg(F.sum(finite(time)).alias("exposure"))
    events = data.filter(F.col(cause).isNotNull()).groupBy(*by, cause).agg(F.count("*").alias("n_events"))
    return events.join(exposure, list(by)).withColumn("hazard", ratio("n_events", "exposure"))
